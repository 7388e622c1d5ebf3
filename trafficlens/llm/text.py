"""Column helpers for whole texts: null as empty, ASCII lower case, words, deterministic folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only. Texts without other letters take the faster built-in."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def words(text: Column) -> Column:
    """Array of the words of a text that is not null; empty without words."""
    spaced = F.trim(F.regexp_replace(text, GAP, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two columns, never null, that tell rows apart by (id, text)."""
    return F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64(doc_id.isNull(), text).alias("_text")


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as the column says, without that column."""
    return df.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).drop("_n", times)
