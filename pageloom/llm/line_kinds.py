"""Problem 3: text statistics of documents and the kind of each line, by a hidden Markov model over line statistics.

Every line that isn't blank gets discrete statistics (length, shares of letters, digits and symbols, markers, endings, columns,
common words, whether its break looks like a wrapped line, ...). The states of the chain are prose, list, table and junk; emissions
are independent given the state. The model is learned from a bounded sample of documents that readers labelled: lines start with
their document's label, then the chain relabels them, documents whose label it contradicts are left out, and it is fitted again.
A document's kind is the one that holds most of its characters, so prose with a short list stays prose.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .language_id import best_paths, words_of

KINDS = ("prose", "list", "table", "junk")
#: Bounds of the training sample: labelled documents, and characters in all.
SAMPLE_DOCS = 6000
SAMPLE_CHARS = 12_000_000
TOP = 0x3100

# Common words of the project's languages, from which the share of common words is told.
COMMON_WORDS = frozenset(
    """the of and to in a is that for it was on with as by at from this be are not or an his her our your their my but which
    le la les de des du et un une que qui dans pour sur pas au aux avec sans ou par il elle nous notre votre ce cette est sont
    der die das den dem des und ist von mit für ein eine nicht im am auf zu aus bei nach wird oder unser unsere unserer ohne
    el los las y en del por con una no se su al es para como lo sin pero nuestra nuestro sobre entre
    il lo gli e di che della dello dei delle non per con sono del nel alla nella senza nostra nostro sul
    o os as e do da dos das em um uma não com se na no ao pelo pela sem nossa nosso
    het een van en in op voor met niet te dat die zijn aan bij naar onze ons zonder door
    في من على إلى عن أن لا ما هذا هذه التي الذي مع كان قبل بعد""".split()
)

LETTER, UPPER, DIGIT, SPACE, VOWEL, STOP, SYMBOL, COLUMN = (1 << k for k in range(8))


def _classes() -> np.ndarray:
    out = np.zeros(TOP + 1, dtype="uint8")
    for c in range(TOP):
        ch, cat = chr(c), unicodedata.category(chr(c))
        if cat[0] in "LM":
            out[c] |= LETTER | (UPPER if cat in ("Lu", "Lt") else 0)
            base = unicodedata.normalize("NFD", ch)[0].lower()
            out[c] |= VOWEL if base in "aeiouyæœ" or c > 0x24F else 0
        elif cat == "Nd":
            out[c] |= DIGIT
        elif cat[0] == "Z" or ch in "\t\r\n":
            out[c] |= SPACE
        if ch in ".!?؟":
            out[c] |= STOP
        if ch in "|;\t":
            out[c] |= COLUMN
        if cat[0] in "SC" and not out[c] or ch in "#~^*<>=_\\/`|+¿":
            out[c] |= SYMBOL
    out[TOP] = LETTER | VOWEL
    return out


CLASS_OF = _classes()
#: Numbers of levels of the line statistics, in the order of ``statistics``.
LEVELS = (8, 5, 6, 5, 5, 6, 6, 5, 4, 5, 4, 4, 5, 4, 3, 5, 4, 4, 5, 4)


def _cut(x: np.ndarray, *edges: float) -> np.ndarray:
    return np.searchsorted(np.asarray(edges), x, side="right").astype("int8")


def statistics(lines: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Levels (lines x statistics) of non-blank lines and raw counts of them; owner: the document of each line, ascending."""
    n = len(lines)
    text = "\n".join(lines.to_pylist()) + "\n"
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="uint32")
    kind = CLASS_OF[np.minimum(raw, TOP)]
    kind[raw == 0xFFFD] = SYMBOL
    stop = np.flatnonzero(raw == 10)
    start = np.r_[0, stop[:-1] + 1]
    length = stop - start

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.cumsum(mask, dtype="int32")
        return (total[stop] - np.where(start > 0, total[start - 1], 0)).astype("float64")

    is_letter, is_digit, is_space = (kind & LETTER) > 0, (kind & DIGIT) > 0, (kind & SPACE) > 0
    letters, digits, symbols = count(is_letter), count(is_digit), count((kind & SYMBOL) > 0)
    vowels, ascii_letters = count(((kind & VOWEL) > 0)), letters
    after_space = np.r_[True, is_space[:-1]]
    words = count(after_space & ~is_space)
    numbers = count(after_space & is_digit)
    runs = count(np.r_[False, (raw[1:] == raw[:-1]) & ~is_space[1:]])
    mixed = count(np.r_[False, (is_letter[1:] & is_digit[:-1]) | (is_digit[1:] & is_letter[:-1])])
    gaps = count(np.r_[False, is_space[1:] & is_space[:-1] & (raw[1:] != 10) & (raw[:-1] != 10)])
    columns = count((kind & COLUMN) > 0)
    dots = count(np.r_[False, (raw[1:] == 46) & (raw[:-1] == 46)])
    is_stop = (kind & STOP) > 0
    sentence = count(is_stop & np.r_[False, is_letter[:-1]] & np.r_[is_space[1:], True])
    colon = count(raw == 58)
    # first and last signs; lines are stripped, so they aren't blanks
    at = lambda k: np.minimum(start + k, stop)
    c = [raw[at(k)] for k in range(4)]
    k0, k1, k2 = (kind[at(k)] for k in range(3))
    mark = np.isin(c[1], (46, 41)) | (((k1 & DIGIT) > 0) & np.isin(c[2], (46, 41))) | (((k2 & DIGIT) > 0) & np.isin(c[3], (46, 41)))
    first = np.zeros(n, dtype="int8")
    first[(k0 & LETTER) > 0] = 1
    first[(k0 & UPPER) > 0] = 2
    first[(k0 & DIGIT) > 0] = 3
    first[np.isin(c[0], [ord(x) for x in "-–—•*·▪☐☑□○●►"])] = 4
    first[(((k0 & (DIGIT | LETTER)) > 0) & mark) | ((c[0] == 91) & (c[2] == 93))] = 5
    last_raw, last_kind = raw[np.maximum(stop - 1, start)], kind[np.maximum(stop - 1, start)]
    last = np.zeros(n, dtype="int8")
    last[(last_kind & LETTER) > 0] = 1
    last[(last_kind & DIGIT) > 0] = 2
    last[(last_kind & STOP) > 0] = 3
    last[last_raw == 44] = 4
    last[last_raw == 45] = 5
    # words
    codes, vocabulary, lengths = words_of(lines)
    usual = np.array([w.strip(".,;:!?\"'()«»").lower().rpartition("'")[2] in COMMON_WORDS for w in vocabulary], dtype=bool)
    common = np.bincount(np.repeat(np.arange(n), lengths), weights=usual[codes], minlength=n) if len(codes) else np.zeros(n)
    space_at = np.flatnonzero(is_space)
    first_word = space_at[np.minimum(np.searchsorted(space_at, start), len(space_at) - 1)] - start
    # neighbours and documents
    same_next = np.r_[owner[1:] == owner[:-1], False]
    same_prev = np.r_[False, owner[1:] == owner[:-1]]
    docs, where = np.unique(owner, return_inverse=True)
    widest = np.zeros(len(docs))
    np.maximum.at(widest, where, length)
    next_word = np.r_[first_word[1:], 0]
    wraps = np.where(same_next, np.where(length + 1 + next_word > widest[where] - 3, 2, 1), 0)
    per = lambda x: np.bincount(where, weights=x, minlength=len(docs))
    n_lines = per(np.ones(n))
    doc_wrap = per(wraps == 2) / np.maximum(n_lines - 1, 1)
    doc_sentence = per(sentence) / np.maximum(per(words), 1)
    doc_bullet = per(first >= 4) / n_lines
    doc_columns = per((columns >= 2) | (gaps >= 2) | (numbers >= 2)) / n_lines
    size = np.maximum(length, 1)
    w = np.maximum(words, 1)
    starts_low = np.r_[(first[1:] == 1) & ~((last[:-1] == 3)), False] & same_next
    levels = np.stack(
        [
            _cut(length, 8, 16, 26, 40, 60, 90, 140),
            _cut(letters / size, 0.3, 0.5, 0.65, 0.8),
            first,
            _cut(digits / size, 0.001, 0.06, 0.15, 0.35),
            _cut(symbols / size, 0.001, 0.04, 0.12, 0.3),
            last,
            _cut(words, 2, 3, 5, 8, 14),
            _cut(numbers / w, 0.001, 0.15, 0.3, 0.5),
            _cut(columns + gaps, 1, 2, 4),
            _cut(runs / size, 0.05, 0.12, 0.25, 0.5),
            _cut(mixed / size, 0.001, 0.05, 0.15),
            _cut(dots, 1, 3, 6),
            _cut(vowels / np.maximum(ascii_letters, 1), 0.1, 0.22, 0.3, 0.55),
            _cut(sentence, 1, 2, 4),
            wraps.astype("int8"),
            _cut(common / w, 0.01, 0.12, 0.25, 0.4),
            (starts_low * 1 + same_prev * 2).astype("int8"),
            _cut(doc_wrap[where], 0.25, 0.55, 0.8),
            _cut(doc_sentence[where], 0.003, 0.02, 0.045, 0.08),
            _cut(np.maximum(doc_bullet, doc_columns)[where], 0.15, 0.5, 0.8),
        ],
        axis=1,
    )
    raw_counts = {"chars": length.astype("float64"), "words": words, "letters": letters, "symbols": symbols, "common": common, "stops": (last == 3).astype("float64")}
    return levels, raw_counts


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Stripped non-blank lines, their owners, and their places among all lines of the text."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lines = pc.utf8_trim_whitespace(pc.list_flatten(lists))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    full = pc.greater(pc.utf8_length(lines), 0)
    kept = full.to_numpy(zero_copy_only=False)
    lines = pc.filter(lines, full)
    return (lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines), owner[kept], place[kept]


class LineModel:
    """Emission tables (statistic, level, state), state weights and the log probability of a change of state."""

    DAMP = 0.6  # statistics of a line overlap, so their joint evidence counts for less

    def __init__(self, tables: list[np.ndarray], start: np.ndarray, switch: float):
        self.tables, self.start, self.switch = tables, start, switch

    @classmethod
    def fit(cls, levels: np.ndarray, state: np.ndarray, owner: np.ndarray) -> LineModel:
        n = len(KINDS)
        per_doc = 1.0 / np.sqrt(np.bincount(owner)[owner]) if len(owner) else np.zeros(0)  # long documents count less per line
        tables = []
        for k, m in enumerate(LEVELS):
            t = np.bincount(levels[:, k].astype("int64") * n + state, weights=per_doc, minlength=m * n).reshape(m, n)
            t = t + 0.05 + 0.02 * t.sum(1, keepdims=True) / max(t.sum(), 1.0) * t.sum(0) / m
            tables.append(np.log(t / t.sum(0)).astype("float32"))
        start = np.bincount(state, weights=per_doc, minlength=n) + 1.0
        changes = (state[1:] != state[:-1]) & (owner[1:] == owner[:-1])
        same = (owner[1:] == owner[:-1]).sum()
        rate = (changes.sum() + 1.0) / (same + 100.0)
        return cls(tables, np.log(start / start.sum()), float(np.log(min(rate, 0.02))))

    def emissions(self, levels: np.ndarray) -> np.ndarray:
        out = np.zeros((len(levels), len(KINDS)), dtype="float32")
        for k, t in enumerate(self.tables):
            out += t[levels[:, k]]
        return self.DAMP * out

    def path(self, levels: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
        lengths = np.bincount(owner, minlength=n_docs).astype("int64")
        return best_paths(self.emissions(levels), lengths, np.repeat(self.start[None, :], n_docs, 0), self.switch)


def shares(path: np.ndarray, owner: np.ndarray, chars: np.ndarray, n_docs: int) -> np.ndarray:
    """Share of each document's characters (without blank lines) in lines of each kind; zeros where it has none."""
    held = np.bincount(owner * len(KINDS) + path, weights=np.maximum(chars, 1), minlength=n_docs * len(KINDS)).reshape(n_docs, len(KINDS))
    return held / np.maximum(held.sum(1, keepdims=True), 1e-9)


def fit(texts: list[str], labels: list[str], rounds: int = 4) -> LineModel:
    lines, owner, _ = split_lines(pa.array(texts, pa.large_string()))
    levels, raw = statistics(lines, owner)
    wanted = np.array([KINDS.index(x) for x in labels], dtype="int64")
    state, kept = wanted[owner], np.ones(len(owner), dtype=bool)
    model = None
    for _ in range(rounds):
        model = LineModel.fit(levels[kept], state[kept].astype("int64"), owner[kept])
        path = model.path(levels, owner, len(texts))
        kind = shares(path, owner, raw["chars"], len(texts)).argmax(1)
        agrees = kind == wanted
        kept, state = agrees[owner], path.astype("int64")
    return model


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> LineModel:
    """Fit on at most ``rows`` documents with one known label, in hash order; labels that contradict each other count for none."""
    kinds = labels.filter(F.col("kind").isin(*KINDS)).groupBy(F.col("doc_id").alias("item_id")).agg(F.min("kind").alias("kind"), F.max("kind").alias("other")).filter("kind = other")
    picked = kinds.orderBy(F.xxhash64("item_id", F.lit(3)), "item_id").select("item_id", "kind").limit(rows)
    texts, kept, chars = [], [], 0
    for r in documents.select("item_id", "text").join(picked, "item_id").select("item_id", "text", "kind").orderBy("item_id").toLocalIterator():
        if r[1] and r[1].strip():
            chars += len(r[1])
            if chars > SAMPLE_CHARS:
                break
            texts.append(r[1])
            kept.append(r[2])
    if not texts:  # nothing to learn from: everything readable is prose
        texts, kept = ["a line of text."], ["prose"]
    return fit(texts, kept)


RESULT = (
    "src string, item_id long, n_lines long, n_words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, "
    "prose double, list double, `table` double, junk double, kind string, line_kinds array<string>"
)


def describe(items: DataFrame, model: LineModel) -> DataFrame:
    """items(src, item_id, text, n_units) -> statistics, label shares, kind and the kinds of all non-blank lines.

    n_lines is n_units where given (boxes), else the number of non-blank lines. Null and blank texts have zero statistics, no
    lines and a null kind. Ties between kinds go to the first of prose, list, table, junk. Repeated ids give a row each; other
    columns are left out; an empty table gives an empty one.
    """
    shared = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in bounded(batches):
            src, ids, texts, units = (batch.column(i) for i in range(4))
            n = len(ids)
            lines, owner, _ = split_lines(texts)
            if len(lines):
                levels, raw = statistics(lines, owner)
                path = model.path(levels, owner, n)
                held = shares(path, owner, raw["chars"], n)
            else:
                path, raw, held = np.zeros(0, "int8"), {}, np.zeros((n, len(KINDS)))
            per = {k: np.bincount(owner, weights=v, minlength=n) for k, v in raw.items()} or {k: np.zeros(n) for k in ("chars", "words", "letters", "symbols", "common", "stops")}
            n_lines = np.bincount(owner, minlength=n)
            names = np.array(KINDS, dtype=object)
            starts = np.searchsorted(owner, np.arange(n + 1)).astype("int32")
            words, chars = np.maximum(per["words"], 1), np.maximum(per["chars"], 1)
            yield pa.RecordBatch.from_arrays(
                [
                    src, ids, pc.coalesce(units.cast(pa.int64()), pa.array(n_lines.astype("int64"))), pa.array(per["words"].astype("int64")),
                    pa.array(per["letters"] / words), pa.array(per["symbols"] / chars), pa.array(per["stops"] / np.maximum(n_lines, 1)), pa.array(per["common"] / words),
                    *[pa.array(held[:, k]) for k in range(len(KINDS))],
                    pa.array([names[k] if m else None for k, m in zip(held.argmax(1), n_lines, strict=True)], pa.string()),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(names[path].tolist(), pa.string())),
                ],
                ["src", "item_id", "n_lines", "n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", *KINDS, "kind", "line_kinds"],
            )

    return items.select("src", F.col("item_id").cast("long"), "text", F.col("n_units").cast("long")).mapInArrow(run, RESULT)
