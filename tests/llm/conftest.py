import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, tiny, very long and repeated texts; null ids and sources; repeated rows; columns whose names clash."""
    words = [f"w{k * 7919 % 1009}é" if k % 5 == 0 else f"W{k * 31 % 97}" for k in range(30_000)]
    rows = [(1, None, "en", "b"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, "One", "fr", "a"), (5, "one two", "de", "b"),
            (6, "One  two\x0bTHREE", "en", "a"), (6, "One  two\x0bTHREE", "en", "a"), (7, "one two three", "en", "a"),
            (8, " ".join(words), "en", "a"), (9, " ".join(words), "en", "c"), (10, " ".join(words[:-1] + ["end"]), "en", "c"),
            (None, "no id here at all", "en", "c"), (None, None, None, None), (-5, "Ünïcödé ßtraße Σας 12 34", "de", "ä"), (50, "x" * 5000, "en", "a"),
            (100, "One  two\x0bTHREE", "en", "d")]
    frame = spark.createDataFrame([(*r, None) for r in rows], COLUMNS)
    extra = ["size", "_id", "_text", "_w", "term", "digest", "fingerprint", "score", "label", "_evidence", "position", "copies", "keep_id"]
    return frame.selectExpr("*", *[f"'clash' as `{c}`" for c in extra]).repartition(3)


@pytest.fixture(scope="session")
def small(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").limit(120)
