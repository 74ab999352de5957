"""Word shingles of texts, their document frequencies over a whole corpus in a sketch of bounded size, and exact likeness.

The likeness of two texts is the number of distinct runs of three consecutive words they share over that number in the one that
has more, in lower case with every run of other signs than letters and digits read as one blank. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_CHARS, bounded, written

WIDTH = 3
MIN_WORDS, MIN_DISTINCT = 15, 10
#: Log2 of the least and the most buckets of the sketch, which has about one per word of the corpus between them, of the buckets in one
#: shuffled slice of it, and characters a word. Beyond the most, rare shingles share buckets: more of them are looked at, none is lost.
LEAST_BITS, MOST_BITS, SLICE_BITS, WORD_CHARS = 20, 26, 16, 6
K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
BITMAP = [f"b{k}" for k in range(8)]
#: Sets from this size on have 512 bits, smaller ones 256: the other four words are 0 then and take no room in a shuffle.
LARGE = 64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K2
    x = (x ^ (x >> np.uint64(29))) * K3
    return x ^ (x >> np.uint64(32))


TOP = 0x3100
_rng = np.random.default_rng(20_011)
#: Of each sign below TOP: whether it is a letter or digit, and a random number of its lower case. Odd multipliers by place in a word.
PLAIN = np.array([chr(c).isalnum() for c in range(TOP)])
SIGN = _rng.integers(1, 2**63, TOP, dtype="int64").astype("uint64")[[min(ord(chr(c).lower()[0]), TOP - 1) for c in range(TOP)]]
STEP = _rng.integers(1, 2**63, 64, dtype="int64").astype("uint64") | np.uint64(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order and the number of words of each; lower case, other signs part words.

    Works on the code points of the whole batch at once. A word's hash is a sum over its signs, each with a multiplier by its place.
    """
    strings = ["" if t is None else t for t in texts.to_pylist()]
    raw = np.frombuffer(" ".join(strings).encode("utf-32-le", "surrogatepass"), dtype="uint32")
    lengths = np.fromiter(map(len, strings), dtype="int64", count=len(strings))
    high = raw >= TOP
    low = np.where(high, 0, raw)
    alnum = PLAIN[low]
    if high.any():
        at = np.flatnonzero(high)
        signs, back = np.unique(raw[at], return_inverse=True)
        alnum[at] = np.array([chr(c).isalnum() for c in signs.tolist()])[back]
        far = np.zeros(len(raw), dtype="uint64")
        far[at] = (np.array([ord(chr(c).lower()[0]) for c in signs.tolist()], dtype="uint64") * K1)[back]
    where = np.flatnonzero(alnum)
    if not len(where):
        return np.zeros(0, "uint64"), np.zeros(len(strings), "int64")
    first = np.r_[True, np.diff(where) > 1]
    start = np.flatnonzero(first)
    value = SIGN[low[where]]
    if high.any():
        value[high[where]] = far[where][high[where]]
    place = np.arange(len(where)) - np.repeat(start, np.diff(np.r_[start, len(where)]))
    value *= STEP[place & 63]
    value += (place >> 6).astype("uint64") * K3
    hashes = mixed(np.add.reduceat(value, start))
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    owner = np.searchsorted(begins, where[start], side="right") - 1
    return hashes, np.bincount(owner, minlength=len(strings)).astype("int64")


@dataclass
class Shingles:
    """Shingles of the comparable texts of a batch: one row per text and distinct shingle, grouped by text."""

    text: np.ndarray  # place of the text in the batch
    hash: np.ndarray
    place: np.ndarray  # of its first word among ``words``
    words: np.ndarray
    word_text: np.ndarray
    n_texts: int


def shingle(texts: pa.Array) -> Shingles:
    """Texts of fewer than MIN_WORDS words or MIN_DISTINCT distinct ones have none. Up to 65,536 texts at once."""
    if len(texts) > 1 << 16:
        raise ValueError("more texts than 16 bits can number")
    words, lengths = word_hashes(texts)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    pairs = (owner.astype("uint64") << np.uint64(48)) | (words >> np.uint64(16))
    pairs.sort()
    new = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    fit = (lengths >= MIN_WORDS) & (np.bincount((new >> np.uint64(48)).astype("int64"), minlength=len(lengths)) >= MIN_DISTINCT)
    if len(words) < WIDTH:
        return Shingles(*(np.zeros(0, t) for t in ("int64", "uint64", "int64")), words, owner, len(lengths))
    place = np.flatnonzero((owner[:-2] == owner[2:]) & fit[owner[:-2]])
    h = mixed((words[place] * K1 ^ words[place + 1]) * K2 ^ (words[place + 2] + K3))
    return Shingles(owner[place], h, place, words, owner, len(lengths))


def distinct_by(s: Shingles, level: np.ndarray) -> np.ndarray:
    """Rows of distinct shingles per text in ascending (text, level, hash)."""
    key = (s.text.astype("uint64") << np.uint64(48)) | (level.astype("uint64") << np.uint64(40)) | (s.hash >> np.uint64(24))
    order = np.argsort(key, kind="stable")
    k, h = key[order], s.hash[order]
    return order[np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])]] if len(order) else order


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; the number of buckets is a power of two."""
    return (h >> np.uint64(65 - buckets.bit_length())).astype("int64")


def to_level(count: np.ndarray) -> np.ndarray:
    """Counts below 64 as they are, larger ones by eighths of a doubling, up to 255."""
    c = count.astype("float64")
    return np.where(c < 64, c, np.minimum(255, 64 + np.floor(8 * np.log2(np.maximum(c, 64) / 64)))).astype("uint8")


def _sliced(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(1 << bits, "int32"), False
    for batch in bounded(batches):
        s, seen = shingle(batch.column(0)), True
        one = (s.text.astype("uint64") << np.uint64(48)) | (s.hash >> np.uint64(16))
        one.sort()
        one = one[np.r_[True, one[1:] != one[:-1]]] if len(one) else one
        at = bucket(one << np.uint64(16), 1 << bits)
        at.sort()
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        total[at[begin]] += np.diff(np.r_[begin, len(at)]).astype("int32")
    if seen:
        parts = [zlib.compress(np.minimum(total[k : k + (1 << SLICE_BITS)], 65_535).astype("uint16").tobytes(), 1) for k in range(0, 1 << bits, 1 << SLICE_BITS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(counts), dtype="uint16")
            held[part] = held[part] + x if part in held else x.astype("int64")
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([to_level(v).tobytes() for v in held.values()], pa.binary())], ["part", "levels"])


def sketch(texts: DataFrame) -> np.ndarray:
    """texts(text) -> by hash bucket the level of the shingles' document frequency over all of them, at most 64 MB.

    Each task sends its counts in slices; a slice is summed as a stream, slices in parallel. Buckets of several shingles hold their
    sum, so a level is never too low, and level 1 means that no other text has the shingle.
    """
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(max((chars // WORD_CHARS).bit_length(), LEAST_BITS), MOST_BITS)
    n = 1 << (bits - SLICE_BITS)
    parts = texts.select("text").mapInArrow(lambda batches: _sliced(batches, bits), "part int, counts binary")
    tasks = min(n, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = np.zeros(1 << bits, dtype="uint8")
    for part, levels in parts.repartition(tasks, "part").mapInArrow(_summed, "part int, levels binary").toLocalIterator():
        level[part << SLICE_BITS : (part + 1) << SLICE_BITS] = np.frombuffer(levels, dtype="uint8")
    return level


def bitmaps(text: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Up to 512 bits of each text's shingle set; text must ascend, n is the size of each set."""
    out = np.zeros((len(n), 8), dtype="uint64")
    if len(text):
        bit = (mixed(h ^ K3) >> np.uint64(55)).astype("int64")
        bit = np.where(n[text] >= LARGE, bit, bit & 255)
        mask = np.uint64(1) << (bit & 63).astype("uint64")
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        for k in range(8):
            out[text[first], k] = np.bitwise_or.reduceat(np.where(bit >> 6 == k, mask, np.uint64(0)), first)
    return out


def needed(n: Column, m: Column) -> Column:
    """Shingles two sets of these sizes must share at a likeness of at least 0.5."""
    return F.ceil(F.greatest(n, m) / 2).cast("int")


def may_match(a: str, b: str) -> Column:
    """Sizes within a factor of two, and bitmaps that differ in no more bits than the sets may differ in shingles.

    Two sets' bitmaps differ in at most as many bits as the sets in shingles; a larger map is folded to compare it with a smaller.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    word = lambda t, k: F.col(f"{t}.b{k}")
    full = [F.bit_count(word(a, k).bitwiseXOR(word(b, k))) for k in range(8)]
    fold = [F.bit_count(word(a, k).bitwiseOR(word(a, k + 4)).bitwiseXOR(word(b, k).bitwiseOR(word(b, k + 4)))) for k in range(4)]
    total = lambda xs: sum(xs[1:], xs[0])
    differ = F.when(F.least(n, m) >= LARGE, total(full)).otherwise(total(fold))
    return (F.greatest(n, m) <= 2 * F.least(n, m)) & (differ <= n + m - 2 * needed(n, m))


def prefixes(texts: pa.Array, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, text and place of the rarest shingles of each text, just more than it may lack; by text its size and bitmap.

    Ordered by (level, hash), the same for all texts. Shingles that no other text has are left out.
    """
    s = shingle(texts)
    levels = level[bucket(s.hash, len(level))]
    rows = distinct_by(s, levels)
    text, h = s.text[rows], s.hash[rows]
    n = np.bincount(text, minlength=s.n_texts).astype("int64")
    rank = np.arange(len(text)) - (np.cumsum(n) - n)[text]
    kept = (rank < (n - (n + 1) // 2 + 1)[text]) & (levels[rows] != 1)
    return h[kept], text[kept], rank[kept], n, bitmaps(text, h, n)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in (x for half in bounded([whole], "ta", BATCH_CHARS // 2) for x in bounded([half], "tb", BATCH_CHARS // 2)):
            n = len(part)
            s = shingle(pa.concat_arrays([part.column(2), part.column(3)]))
            rows = distinct_by(s, np.zeros(len(s.hash), "uint8"))
            h, t = s.hash[rows], s.text[rows]
            sizes = np.bincount(t, minlength=2 * n)
            key = ((t % n).astype("uint64") << np.uint64(48)) | (h >> np.uint64(16))
            key.sort()
            shared = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(48)).astype("int64"), minlength=n)
            larger = np.maximum(sizes[:n], sizes[n:])
            good = (larger > 0) & (np.minimum(sizes[:n], sizes[n:]) > 0) & (2 * shared >= larger)
            yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[good]), pa.array(part.column(1).to_numpy()[good]), pa.array(shared[good] / larger[good])], ["a", "b", "likeness"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b), texts(id, text) -> a, b, likeness of those that reach 0.5, from the whole texts."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long, likeness double")


def content_key() -> list[Column]:
    """128 bits of the normalised text: equal for texts of likeness 1 by equal words."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return [F.xxhash64(plain).alias("h1"), F.xxhash64(plain, F.lit(1)).alias("h2")]


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(id, text) -> (members, representatives): id, rep for every record; id, text of the smallest id of each class.

    A class holds the records of equal normalised text. Its smallest id is found by partial aggregation, so a class that holds a
    third of all rows is no single task's work.
    """
    keyed = records.select("id", *content_key())
    least = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    members = written(keyed.join(least, ["h1", "h2"]).select("id", "rep"))  # two numbers a record, read several times
    reps = records.select("id", "text").join(least.select(F.col("rep").alias("id")), "id", "left_semi")
    return members, reps
