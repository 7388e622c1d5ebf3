"""BPE encoding over a trie of distinct words.

The last token of a prefix decides its whole encoding: it is the one vocabulary entry at its end that
stays apart from the last token of what precedes it. A trie node therefore needs only its last token
and the node before that token. The distinct new words of a block of texts form a trie; a depth-first walk
fills in the states, so a prefix that words share is worked out once, and a word's ids are read off by going
back from its end. The tokens that end at a place come from one pass of an automaton over the word. A task
remembers words up to a limit, which changes no result. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.text import whole
from trafficlens.operators.skew import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
# fixed values of the vocabulary's format: how texts fall into words
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
# fixed values: what that says of code points up to 255, letters first (no two kinds begin alike but the endings and the rest)
LATIN_LETTERS, LATIN_NUMBERS, LATIN_BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\x09-\x0d \x85\xa0"
LATIN_PATTERN = f"[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{LATIN_BLANKS}{LATIN_LETTERS}{LATIN_NUMBERS}]+"
# words that a task remembers in each of two generations, and pairs of tokens whose border it knows
REMEMBERED = 150_000
MAX_PAIRS = 300_000
CHARS_AT_ONCE = 2_000_000
# what tells the last letter of a word from the same letter inside one
END = 512


def byte_letters() -> str:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the others from 256 on."""
    itself = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in itself else next(others)) for b in range(256))


class Vocabulary:
    """Token strings, ids, and for every token the pair it is merged from and the rank of that merge.

    Words are written in the letters of their bytes, the last one shifted by END, so that a token for the end of a
    word differs from the same letters inside one.
    """

    def __init__(self, description: bytes):
        parsed = json.loads(description)
        model = parsed["model"]
        end = model["end_of_word_suffix"]
        ids = model["vocab"]
        self.special = {a["content"]: a["id"] for a in parsed["added_tokens"]}
        self.strings = {i: s for s, i in [*ids.items(), *self.special.items()]}
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, made = ids[left], ids[right], ids[left + right]
            self.rank_of_pair[a, b] = rank
            self.halves.setdefault(made, (a, b))
            self.rank.setdefault(made, rank)
        # a word that is a token is that token
        bare = {s[:-len(end)]: i for s, i in ids.items() if s.endswith(end) and s != end}
        self.whole = {s[:-1] + chr(ord(s[-1]) + END): i for s, i in bare.items()}
        # all tokens that end at a place, longest first, in one pass over a word
        self.found = ahocorasick.Automaton()
        for string, made in [*self.whole.items(), *((s, i) for s, i in ids.items() if not s.endswith(end))]:
            self.found.add_word(string, (len(string), made))
        self.found.make_automaton()
        self.pairs: dict[int, bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side as they are.

        Both are unmade step by step, the later merge first (of equal ones the right); a pair across the border that would have
        been merged before the step undone last would have joined them.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        # (rank, side) of the merge undone last: ties in rank go to the left pair first
        bound = (1 << 60, 0)
        while True:
            joined = self.rank_of_pair.get((left, right))
            if joined is not None and (joined, 0) < bound:
                return False
            left_rank, right_rank = self.rank.get(left, -1), self.rank.get(right, -1)
            if left_rank < 0 and right_rank < 0:
                return True
            if left_rank > right_rank:
                bound, left = (left_rank, 0), self.halves[left][1]
            else:
                bound, right = (right_rank, 1), self.halves[right][0]


def walk(words: list[str], vocabulary: Vocabulary) -> dict[str, list[int]]:
    """Ids of distinct marked words, by a depth-first walk of their trie.

    In sorted order the words with a common prefix follow each other, so the branch of the trie that the walk stands
    on is all that must be kept: for every depth the last token of the prefix and the depth before that token. Of the
    next word only what it does not share with the branch is worked out.
    """
    whole, apart, stays = vocabulary.whole, vocabulary.pairs, vocabulary.apart
    found: dict[str, list[int]] = {}
    branch, token, before = "", array("i", [-1]), array("i", [0])
    for word in sorted(words):
        single = whole.get(word)
        if single is not None:
            found[word] = [single]
            continue
        depth = 0
        for a, b in zip(word, branch):
            if a != b:
                break
            depth += 1
        del token[depth + 1:], before[depth + 1:]
        for end, (size, made) in vocabulary.found.iter(word):
            if end < depth:
                continue
            start = end + 1 - size
            if start:
                left = token[start]
                beside = apart.get(left << 20 | made)
                if not (stays(left, made) if beside is None else beside):
                    continue
            token.append(made)
            before.append(start)
            depth = end + 1
        if depth < len(word):
            raise ValueError(f"no token ends {word[:depth + 1]!r}")
        branch, ids = word, []
        while depth:
            ids.append(token[depth])
            depth = before[depth]
        ids.reverse()
        found[word] = ids
    return found


class Memory:
    """Ids, packed, and decoded text of words in two generations: words that are asked for stay, others go when the younger is full."""

    def __init__(self, most: int):
        self.most = most
        self.ids, self.decoded = {}, {}
        self.old_ids, self.old_decoded = {}, {}

    def missing(self, words: set[str]) -> set[str]:
        """The words that are not known; all others are in the younger generation afterwards."""
        if len(self.ids) >= self.most:
            self.old_ids, self.old_decoded, self.ids, self.decoded = self.ids, self.decoded, {}, {}
        lacking = words.difference(self.ids)
        back = lacking.intersection(self.old_ids)
        for word in back:
            self.ids[word], self.decoded[word] = self.old_ids[word], self.old_decoded[word]
        return lacking - back


class Encoder:
    """Texts to ids and back, for one task."""

    def __init__(self, description: bytes, remembered: int = REMEMBERED):
        self.vocabulary = Vocabulary(description)
        self.memory = Memory(remembered)
        self.pattern, self.latin, self.beyond_latin = regex.compile(WORD_PATTERN), re.compile(LATIN_PATTERN), re.compile(r"[^\x00-\xff]")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None
        self.letters = dict(enumerate(byte_letters()))
        top = max(self.vocabulary.strings) + 1
        self.strings = [self.vocabulary.strings.get(i, "") for i in range(top)]

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter: no rule looks at the neighbours of a sigma."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def plain_words(self, text: str) -> list[str]:
        text = self.normal(text)
        return (self.pattern if self.beyond_latin.search(text) else self.latin).findall(text)

    def words(self, text: str) -> list[str]:
        """Words of a text; a special token stands as a word of its own, marked by a blank before it."""
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return self.plain_words(text)
        found = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                found.append(" " + part)
            else:
                found += self.plain_words(part)
        return found

    def spelled(self, word: str) -> str:
        """The word in the letters of its bytes, its end marked."""
        if not (word.isascii() and word.isalnum()):
            word = word.encode().decode("latin-1").translate(self.letters)
        return word[:-1] + chr(ord(word[-1]) + END)

    def learn(self, words: set[str]) -> None:
        spelled = {w: self.spelled(w) for w in words if w[0] != " "}
        found = walk(list(spelled.values()), self.vocabulary)
        strings, packed, decoded = self.strings, self.memory.ids, self.memory.decoded
        for word in words:
            ids = found[spelled[word]] if word[0] != " " else [self.vocabulary.special[word[1:]]]
            packed[word] = array("I", ids).tobytes()
            decoded[word] = " ".join([strings[i] for i in ids])

    def encode_and_decode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids of every text as little-endian 32-bit integers, and the text that they decode to."""
        listed = [self.words(t) for t in texts]
        lacking = self.memory.missing({w for words in listed for w in words})
        if lacking:
            self.learn(lacking)
        ids, decoded = self.memory.ids.__getitem__, self.memory.decoded.__getitem__
        for words in listed:
            yield b"".join(map(ids, words)), " ".join(map(decoded, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for ids, _ in self.encode_and_decode(texts)]

    def decode(self, ids: bytes) -> str:
        """Token strings with blanks between them: the vocabulary names no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _encoded(description: bytes, remembered: int, with_ids: bool, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(description, remembered)
        for batch in batches:
            texts = batch.column(len(kept))
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // CHARS_AT_ONCE)) + 1).tolist(), len(texts)]
            for start, stop in zip(cuts, cuts[1:]):
                counts, ids_hash, text_hash, listed = [], [], [], []
                for ids, decoded in encoder.encode_and_decode(texts[start:stop].to_pylist()):
                    counts.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        listed.append(np.frombuffer(ids, "<u4").astype(np.int32))
                columns = [*(c.slice(start, stop - start) for c in batch.columns[:len(kept)]), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(listed, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _tokens(rows: DataFrame, vocabulary: str, remembered: int, with_ids: bool) -> DataFrame:
    """Rows of (any columns..., text) with tokens in place of the text."""
    with open(vocabulary, "rb") as file:
        description = file.read()
    kept = rows.columns[:-1]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), RESULT + ", ids array<int>" * with_ids])
    return rows.mapInArrow(_encoded(description, remembered, with_ids, kept), schema)


def token_digests(docs: DataFrame, vocabulary: str, remembered: int = REMEMBERED, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of the ids and of the decoded text; `with_ids` adds the ids themselves.

    Null texts count as empty: no tokens, digests of nothing. Texts count whole, however long; rows that repeat come
    out as often, an empty table gives an empty table. Other columns are ignored. `vocabulary` is the path of the
    tokenizer's description on the driver; its content travels with the job.
    """
    return _tokens(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text")), vocabulary, remembered, with_ids)


def token_ids(docs: DataFrame, vocabulary: str, remembered: int = REMEMBERED) -> DataFrame:
    """One row per document: doc_id and its ids; a null text has none. Otherwise like `token_digests`."""
    return token_digests(docs, vocabulary, remembered, with_ids=True).select("doc_id", "ids")


def training_tokens(docs: DataFrame, vocabulary: str, remembered: int = REMEMBERED) -> DataFrame:
    """`token_digests` with ids and position (from 0), the place of the row in the order in which its table was stored.

    Files of a stored table are named in the order of the partitions written, and Spark tells a row's file and place in it,
    while a scan takes files by size. Rows that no file holds are numbered in the order in which they come.
    """
    doc_id, text = F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text")
    try:
        rows = docs.select(doc_id, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"), text)
        sizes = docs.select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("_rows"))
    except AnalysisException:
        rows = docs.select(doc_id, F.monotonically_increasing_id().alias("position"), text)
        return _tokens(rows, vocabulary, remembered, with_ids=True)
    # one row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # stored, so that Spark knows its size
    starts = materialize(sizes.select("file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")), "files")
    found = _tokens(rows, vocabulary, remembered, with_ids=True)
    return found.join(starts, "file").withColumn("position", F.col("_start") + F.col("place")).drop("file", "place", "_start")
