"""Helpers shared by the training-data operators: labels, token sizes, lineage cuts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint, scratch  # noqa: F401 - checkpoint is used by the operators

# The languages of the project and the ways a label may name them.
LANGUAGES = ("ar", "de", "en", "es", "fr", "it", "nl", "pt")
LANGUAGE_NAMES = {
    "ar": "ar", "ara": "ar", "arabic": "ar",
    "de": "de", "deu": "de", "ger": "de", "german": "de",
    "en": "en", "eng": "en", "english": "en",
    "es": "es", "spa": "es", "spanish": "es",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "it": "it", "ita": "it", "italian": "it",
    "nl": "nl", "nld": "nl", "dut": "nl", "dutch": "nl",
    "pt": "pt", "por": "pt", "portuguese": "pt",
}

#: A tokenizer vocabulary or another table that doesn't grow may be brought to the driver up to this size.
MAX_SMALL_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The same rows from a compressed table in the shared folder; computed once, where a checkpoint would compute them twice."""
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key that one task joins; a key with more on the right is split there, and its left rows meet every part.
SPLIT_ROWS = 50_000


def split_join(left: DataFrame, right: DataFrame, key: str, salt: str, rows: int = SPLIT_ROWS) -> DataFrame:
    """Inner join on ``key`` where hot keys are split by the hash of the right side's column ``salt``; other keys stay whole."""
    hot = right.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    cut = right.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(salt), parts).cast("int")).drop("_parts")
    many = left.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return many.join(cut, [key, "_part"]).drop("_part")


def small_rows(df: DataFrame, what: str, limit: int = MAX_SMALL_ROWS) -> list:
    """Rows of a table of bounded size; raises when it is larger than ``limit``."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def label_languages(label: Column) -> Column:
    """Sorted two-letter codes named by a label; an empty array where it names none.

    Null, blank, ``und`` and ``unknown`` name none; a two-letter code outside the project's languages stands for itself.
    """
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    part = lambda x: F.regexp_extract(x, r"^\s*([a-z]+)", 1)
    code = lambda x: F.coalesce(names[part(x)], F.when(F.length(part(x)) == 2, part(x)))
    codes = F.transform(F.split(F.lower(F.coalesce(label, F.lit(""))), r"[+/]"), code)
    return F.array_sort(F.array_distinct(F.filter(codes, lambda x: x.isNotNull())))


_SPLIT = re.compile(r"[^ \t\n]+")


class GreedyTokenizer:
    """Longest-match sizes of words under a piece vocabulary, with a memo of bounded size."""

    def __init__(self, pieces: Iterable[str], memo: int = 400_000):
        self.pieces = frozenset(pieces)
        self.longest = max(map(len, self.pieces), default=1)
        self.memo: dict[str, int] = {}
        self.limit = memo

    def __reduce__(self):
        return GreedyTokenizer, (self.pieces, self.limit)

    def word(self, word: str) -> int:
        text, at, n = "▁" + word, 0, 0
        end = len(text)
        while at < end:
            for stop in range(min(end, at + self.longest), at + 1, -1):
                if text[at:stop] in self.pieces:
                    at = stop
                    break
            else:
                at += 1
            n += 1
        return n

    def size(self, text: str | None) -> int:
        if not text:
            return 0
        memo, total = self.memo, 0
        for word in _SPLIT.findall(text):
            n = memo.get(word)
            if n is None:
                n = self.word(word)
                if len(word) <= 64:
                    if len(memo) >= self.limit:
                        memo.clear()
                    memo[word] = n
            total += n
        return total


def load_tokenizer(vocab: DataFrame) -> GreedyTokenizer:
    """The greedy tokenizer of a vocabulary table (``piece``, ``kind``); only pieces of kind ``text`` match."""
    rows = small_rows(vocab.filter("kind = 'text' and piece is not null and piece <> ''").select("piece").distinct(), "tokenizer vocabulary")
    return GreedyTokenizer(r[0] for r in rows)


def token_size(tokenizer: GreedyTokenizer, spark: SparkSession):
    """Arrow UDF: text -> size in tokens; null and blank texts have size 0."""
    shared = spark.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("long")
    def sizes(texts: pd.Series) -> pd.Series:
        size = shared.value.size
        return pd.Series([size(t) for t in texts], dtype="int64")

    return sizes


class Rows:
    """Rows of numbers that are added one by one and read by many at once."""

    def __init__(self, width: int, dtype: str):
        self.held, self.n = np.zeros((1024, width), dtype), 0

    def add(self, row) -> int:
        if self.n == len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n] = row
        self.n += 1
        return self.n - 1

    def extend(self, rows: np.ndarray) -> range:
        while self.n + len(rows) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)
        return range(self.n - len(rows), self.n)

    def at(self, places) -> np.ndarray:
        return self.held[np.asarray(places, dtype="int64")]

    def clear(self) -> None:
        self.n = 0


#: Characters of text that a model looks at together; a longer single text is looked at alone.
BATCH_CHARS = 8_000_000
#: Rows of a batch; ``shingles`` packs a row's place in its batch into 16 bits.
BATCH_ROWS = 32_768


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text, so that long texts don't meet in memory by the thousand, and of bounded length."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy(zero_copy_only=False).astype("int64"))
        start = 0
        while start < len(batch):
            stop = max(start + 1, min(start + BATCH_ROWS, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop

