"""Problem 8: reading level of English documents, by a linear pairwise ranker with isotonic calibration.

Graded documents give pairs: a sentence of a document of a higher level, one of a document of a lower level. A linear scorer over
syntax and vocabulary features learns to rank them (logistic loss on feature differences); isotonic regression turns scores into
levels. A document has the level of most of its sentences.

The first graded documents are the anchors; vocabulary features of an anchor's own sentences are computed without that anchor, so
the ranker doesn't learn the anchors by heart. They are few, and most words of a corpus aren't in them. So the ranker then grades a
bounded sample of English texts, keeps those of which most sentences agree, and is fitted again on these and the anchors.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LANGUAGES, Rows, bounded, label_languages, small_rows
from .language_id import MIN_RUN, WordModel, classify, label_evidence
from .line_kinds import KINDS, LineModel, shares, split_lines, statistics

MAX_ANCHORS = 10_000
#: Bounds of the fit: English texts graded beside the anchors, their characters in all, and sentence pairs.
SAMPLE_TEXTS = 1000
SAMPLE_CHARS = 1_500_000
PAIRS = 60_000
#: Share of its sentences that must agree for a graded text to count, and how often the fit is repeated.
AGREED = 0.6
ROUNDS = 3
# English words that join clauses, and common English function words.
JOINING = frozenset("which that who whom whose because although though if since when while whereas until unless before after so but and or as than where albeit inasmuch insofar notwithstanding therefore".split())
FUNCTION = frozenset("a an the this that these those my your our their his her its every any one of to in on at by for with from about into under behind near past next before after as is was has had have been be did not can cannot must may should will would and but or so if since because although when until we you they she he it nobody".split())
_END = re.compile(r"(?<=[.!?;])[\"')\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MARK = re.compile(r"^\s*(?:[-–—•*·]|\(?\w{1,3}[.)]|\[.?\])\s+")


def sentences(lines: list[str]) -> list[list[str]]:
    """Word lists of the sentences of prose lines, of three words and more; words broken at a line's end are joined.

    Sentences end at a mark, and, as marks get lost, before a capitalised function word that comes after three words or more; not so
    in texts in capitals or titles, where half the words begin with one.
    """
    text = ""
    for line in lines:
        line = _MARK.sub("", line).strip()
        if text.endswith("-") and len(text) > 1 and text[-2].isalpha() and line[:1].islower():
            text = text[:-1] + line
        else:
            text = f"{text} {line}" if text else line
    out = []
    for part in _END.split(text):
        words = _WORD.findall(part)
        upper = [k for k, w in enumerate(words) if w[0].isupper()]
        if len(upper) * 2 < len(words):
            start = 0
            for k in upper:
                if k - start >= 3 and words[k].lower() in FUNCTION:
                    out.append(words[start:k])
                    start = k
            words = words[start:]
        if len(words) >= 3:
            out.append(words)
    return out


def syllables(word: str) -> int:
    return max(1, len(re.findall(r"[aeiouy]+", word)) - (word.endswith("e") and len(word) > 3))


RELATIVE = frozenset(("which", "that", "who"))


class WordFacts:
    """What the features need of a word, computed once per distinct word; the memo is of bounded size."""

    def __init__(self, word_level: dict[str, float], by_length: dict[int, float], limit: int = 300_000):
        self.word_level, self.by_length, self.limit = word_level, by_length, limit
        self.place: dict[str, int] = {}
        self.rows = Rows(7, "float64")

    def of(self, word: str) -> int:
        k = self.place.get(word)
        if k is None:
            low = word.lower()
            level = self.word_level.get(low, self.by_length.get(min(len(low), 16), 2.5))
            k = self.place[word] = self.rows.add((len(low), syllables(low), low in FUNCTION, low in JOINING, low in RELATIVE, word[0].isupper(), level))
        return k

    def table(self, words: list[str]) -> np.ndarray:
        if len(self.place) > self.limit:
            self.place.clear()
            self.rows.clear()
        return self.rows.at([self.of(w) for w in words])


def features(parts: list[list[str]], facts: WordFacts) -> np.ndarray:
    """One row per sentence: length, word lengths, syllables, joining and relative words, function words, vocabulary levels.

    Word figures are over content words: no function words, names within the sentence or words of two letters; over all words
    where a sentence has none.
    """
    n = np.array([len(p) for p in parts])
    start = np.cumsum(n) - n
    t = facts.table([w for p in parts for w in p])
    size, beats, function, joining, relative, upper, level = t.T
    inside = np.ones(len(t), dtype=bool)
    inside[start] = False
    content = (function == 0) & ~((upper == 1) & inside) & (size > 2)
    none = np.add.reduceat(content.astype("float64"), start) == 0
    content |= np.repeat(none, n)
    total = lambda x: np.add.reduceat(np.where(content, x, 0.0), start)
    m = total(1.0)
    return np.stack(
        [
            np.log(n),
            total(size) / m,
            *(total((size >= k).astype("float64")) / m for k in (6, 9, 12, 15)),
            total(beats) / m,
            np.add.reduceat(joining, start) / np.sqrt(n),
            np.minimum(3, np.add.reduceat(relative, start)),
            np.add.reduceat(function, start) / n,
            total(level) / m,
            np.maximum.reduceat(np.where(content, level, -1e9), start),
            np.minimum.reduceat(np.where(content, level, 1e9), start),
        ],
        axis=1,
    )


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending knots and non-decreasing values of the weighted least-squares fit."""
    order = np.argsort(x, kind="stable")
    weight = np.ones(len(x)) if weight is None else weight
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, hi = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + v * w) / (b[1] + w), b[1] + w, hi
    knots = np.array([e for b in blocks for e in (b[2], b[3])])
    return knots, np.repeat([b[0] for b in blocks], 2)


def vocabulary(parts: list[list[str]]) -> Counter:
    """Words of a document's sentences but names within them; a word counts up to three times."""
    counts = Counter(w.lower() for ws in parts for k, w in enumerate(ws) if not (w[0].isupper() and k))
    return Counter({w: min(n, 3) for w, n in counts.items()})


def pair_weights(z: np.ndarray, y: np.ndarray, pairs: int, penalty: float, seed: int = 0) -> np.ndarray:
    """Weights of the linear scorer from sentence pairs of all pairs of levels: all of them, or evenly drawn up to ``pairs``."""
    rng, by = np.random.default_rng(seed), [np.flatnonzero(y == k) for k in np.unique(y)]
    both = [(a, b) for i, a in enumerate(by) for b in by[i + 1 :]]
    each = pairs // max(len(both), 1)
    lo, hi = [], []
    for a, b in both:
        n = len(a) * len(b)
        at = np.arange(n) if n <= each else rng.integers(0, n, each)
        lo.append(a[at // len(b)])
        hi.append(b[at % len(b)])
    w = np.zeros(z.shape[1])
    if not both:
        return w
    d = z[np.concatenate(hi)] - z[np.concatenate(lo)]
    for _ in range(100):  # Newton steps of the pairwise logistic loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + penalty * np.eye(len(w)), d.T @ (1 - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Ranker:
    def __init__(self, mean, scale, weight, knots, values, word_level, by_length, levels):
        self.mean, self.scale, self.weight, self.knots, self.values = mean, scale, weight, knots, values
        self.word_level, self.by_length, self.levels = word_level, by_length, levels
        self.facts = WordFacts(word_level, by_length)

    def __reduce__(self):
        return Ranker, (self.mean, self.scale, self.weight, self.knots, self.values, self.word_level, self.by_length, self.levels)

    @classmethod
    def fit_graded(cls, graded: list[tuple[int, list[list[str]]]], left_out: bool = True, penalty: float = 1.0, pairs: int = PAIRS) -> Ranker:
        """graded: level and sentences of each document; with ``left_out`` a document's words don't grade its own sentences."""
        graded = [(level, parts) for level, parts in graded if parts]
        if not graded:
            raise ValueError("no graded text has a sentence")
        totals: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        own = [vocabulary(parts) for _, parts in graded]
        for (level, _), c in zip(graded, own, strict=True):
            for w, v in c.items():
                t = totals[w]
                t[0] += v
                t[1] += level * v
        mean_level = float(np.mean([level for level, _ in graded]))

        def table(left: Counter = Counter(), left_level: int = 0) -> tuple[dict[str, float], dict[int, float]]:
            out, sums = {}, defaultdict(list)
            for w, (n, s) in totals.items():
                if w in left:
                    n, s = n - left[w], s - left_level * left[w]
                if n > 0:
                    out[w] = (s + mean_level) / (n + 1)
                    sums[min(len(w), 16)].append(s / n)
            return out, {k: float(np.mean(v)) for k, v in sums.items()}

        whole = table()
        shared = WordFacts(*whole)
        rows = [features(parts, WordFacts(*table(c, level)) if left_out else shared) for (level, parts), c in zip(graded, own, strict=True)]
        x, y = np.concatenate(rows), np.repeat([level for level, _ in graded], [len(parts) for _, parts in graded]).astype("float64")
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = (x - mean) / scale
        weight = pair_weights(z, y, pairs, penalty)
        sizes = dict(zip(*np.unique(y, return_counts=True), strict=True))
        knots, values = isotonic(z @ weight, y, np.array([1 / sizes[v] for v in y]))  # levels weigh the same, whatever their sentences
        return cls(mean, scale, weight, knots, values, *whole, sorted(int(k) for k in sizes))

    @classmethod
    def fit(cls, anchors: list[tuple[int, str]], texts: list[list[list[str]]] = (), rounds: int = ROUNDS) -> Ranker:
        """Fit on anchors (level, text), then on these and the sentence lists of ungraded texts that it grades clearly."""
        graded = [(level, sentences(text.split("\n"))) for level, text in anchors if text]
        ranker = cls.fit_graded(graded)
        for _ in range(rounds if texts else 0):
            more = []
            for parts in texts:
                if len(parts) >= 3:
                    level, n = Counter(ranker.level_of(parts).tolist()).most_common(1)[0]
                    if n >= AGREED * len(parts):
                        more.append((level, parts))
            ranker = cls.fit_graded(graded + more, left_out=False)
        return ranker

    def level_of(self, parts: list[list[str]]) -> np.ndarray:
        """Level of each sentence."""
        z = (features(parts, self.facts) - self.mean) / self.scale
        fine = np.interp(z @ self.weight, self.knots, self.values)
        known = np.array(self.levels)
        return known[np.abs(fine[:, None] - known[None, :]).argmin(1)]


def english_sentences(texts: list[str], languages: WordModel, lines: LineModel) -> list[list[list[str]]]:
    """Sentences of the prose lines of those texts that are in English only."""
    if not texts:
        return []
    found, parts = described(pa.array(texts, pa.large_string()), [["en"]] * len(texts), languages, lines)
    return [p for langs, p in zip(found["languages"], parts, strict=True) if langs == ["en"]]


def train(anchors: DataFrame, sample: list[tuple[str, str, list[str]]] = (), languages: WordModel | None = None, lines: LineModel | None = None) -> Ranker:
    """Fit on the graded texts (level, text), a table that doesn't grow, and on sampled texts (``language_id.sampled``) labelled English."""
    rows = small_rows(anchors.filter("level is not null and text is not null").select("level", "text"), "anchors", MAX_ANCHORS)
    texts, chars = [], 0
    for _, text, langs in sample:
        if langs == ["en"] and len(texts) < SAMPLE_TEXTS and chars + len(text) <= SAMPLE_CHARS:
            texts.append(text)
            chars += len(text)
    return Ranker.fit([(int(r[0]), r[1]) for r in sorted(rows)], english_sentences(texts, languages, lines) if languages else [])


def described(texts: pa.Array, declared: list[list[str]], model: WordModel, chain: LineModel) -> tuple[dict[str, list], list[list[list[str]]]]:
    """Languages, kind and number of letter words of each text, and the sentences of its prose lines."""
    n = len(texts)
    (item, chosen, _, count, _), letters = classify(model, texts, np.array([label_evidence(x) for x in declared]))
    langs: list[set] = [set() for _ in range(n)]
    for i, c, m in zip(item.tolist(), chosen.tolist(), count.tolist(), strict=True):
        if m >= MIN_RUN and c < len(LANGUAGES):
            langs[i].add(LANGUAGES[c])
    rows, owner, _ = split_lines(texts)
    kinds: list[str | None] = [None] * n
    prose: list[list[str]] = [[] for _ in range(n)]
    if len(rows):
        stats, raw = statistics(rows, owner)
        path = chain.path(stats, owner, n)
        held = shares(path, owner, raw["chars"], n).argmax(1)
        for i in np.unique(owner).tolist():
            kinds[i] = KINDS[held[i]]
        kept = path == 0
        for i, line in zip(owner[kept].tolist(), rows.filter(pa.array(kept)).to_pylist(), strict=True):
            prose[i].append(line)
    return {"languages": [sorted(x) for x in langs], "kind": kinds, "letters": letters}, [sentences(x) for x in prose]


RESULT = "item_id long, languages array<string>, kind string, n_letter_words long, n_sentences int, level int, level_share double"


def levels(items: DataFrame, languages: WordModel, lines: LineModel, ranker: Ranker) -> DataFrame:
    """items(item_id, text, label) -> languages, kind, letter words, sentences, level and the share of sentences at it.

    The level is null where no prose line has a sentence of three words. Of tied levels the one nearest to the mean of all
    sentences counts, then the lower. It is given for every text; use ``languages`` and ``kind`` to keep English prose. Null and
    empty texts give a row without level; repeated ids a row each; other columns are left out; an empty table an empty one.
    """
    shared = items.sparkSession.sparkContext.broadcast((languages, lines, ranker))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chain, ranker = shared.value
        for batch in bounded(batches):
            ids, texts, declared = (batch.column(k) for k in range(3))
            seen, parts = described(texts, declared.to_pylist(), model, chain)
            sizes = np.array([len(p) for p in parts])
            flat = [ws for p in parts for ws in p]
            found = ranker.level_of(flat) if flat else np.zeros(0, "int64")
            level: list[int | None] = []
            share: list[float | None] = []
            for start, m in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
                own = found[start : start + m]
                if not m:
                    level.append(None)
                    share.append(None)
                    continue
                tally, mean = Counter(own.tolist()), float(own.mean())
                best = min(tally, key=lambda k: (-tally[k], abs(k - mean), k))
                level.append(best)
                share.append(tally[best] / m)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(seen["languages"], pa.list_(pa.string())), pa.array(seen["kind"], pa.string()), pa.array(seen["letters"]), pa.array(sizes.astype("int32")), pa.array(level, pa.int32()), pa.array(share, pa.float64())],
                ["item_id", "languages", "kind", "n_letter_words", "n_sentences", "level", "level_share"],
            )

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text", label_languages(F.col("label")).alias("declared")).mapInArrow(run, RESULT)


def english_prose(levelled: DataFrame, min_words: int = 60) -> DataFrame:
    """item_id, level of documents in English prose only with enough letter words."""
    return levelled.filter((F.col("kind") == "prose") & (F.array_join("languages", "+") == "en") & (F.col("n_letter_words") >= min_words) & F.col("level").isNotNull()).select("item_id", "level")
