"""Problem 1: the language of documents and of their parts, with a confidence, by Bayesian evidence fusion.

Evidence, in log space:
* text: per word, the likelihood under each language and under an "unreadable" class, from word counts mixed with character
  trigrams. It is learned from a bounded sample of labelled texts whose wrong labels are repaired by expectation-maximisation;
* the declared label: a label names a wrong language with probability LABEL_ERROR, a missing one says nothing;
* the host (source, shard or page set): the distribution of languages its items declare, computed by grouped aggregation and
  smoothed hierarchically: item set -> kind of host -> host.

A hidden Markov chain over the words joins them: its start and its switches are weighted by label and host, its emissions are
the text likelihoods, and the best path cuts a text into segments of one language each. A segment's confidence is the posterior
of its language over that segment's words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LANGUAGES, Rows, bounded, label_languages, small_rows

UNREADABLE = "zxx"
CLASSES = (*LANGUAGES, UNREADABLE)
#: Bound of the training sample, in labelled rows of each item set; the model is fitted on the driver.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 6_000_000
LABEL_ERROR = 0.1
#: A text of more letter words counts as this many in the fit, so that no single text makes up a language.
TEXT_WORDS = 200
#: Log probability of changing the language between two words.
SWITCH = -9.0
#: Letter words in a row that make a language count.
MIN_RUN = 10
#: Weight of declared counts against the level above in the host prior.
PRIOR_WEIGHT = 20.0
#: Host priors are broadcast up to this many hosts; beyond it they are joined by shuffle.
MAX_HOSTS = 50_000
TRIGRAM_BITS = 17
LETTERS = re.compile(r"[^\W\d_]")
VOWELS = re.compile("[aeiouy]")


def segment_schema() -> str:
    return "array<struct<lang: string, first_word: int, n_words: int, confidence: float>>"


def letter_word(word: str) -> bool:
    return len(LETTERS.findall(word)) >= 2


def clean(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}«»„“”‘’-–—*•|/").lower()


@lru_cache(maxsize=1 << 18)
def hash3(s: str) -> int:
    h = 0
    for c in s:
        h = (h * 1_000_003 + ord(c)) & 0xFFFFFFFF
    return (h ^ (h >> 13)) & ((1 << TRIGRAM_BITS) - 1)


def gram_places(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words in order, and the word each belongs to; an empty word has none."""
    place, sizes = [], []
    for w in names:
        v = f"^{w}$"
        place += [hash3(v[i : i + 3]) for i in range(len(v) - 2)] if w else []
        sizes.append(len(w))
    return np.array(place, dtype="int64"), np.repeat(np.arange(len(names)), sizes)


class WordModel:
    """Log likelihood of words under each class: known words by count, all by tempered trigrams."""

    TEMPER = 0.55  # trigrams overlap, so their joint evidence counts for less

    def __init__(self, vocabulary: dict[str, int], words: np.ndarray, grams: np.ndarray):
        self.vocabulary, self.words, self.grams = vocabulary, words, grams
        self.memo: dict[str, int] = {}
        self.rows = Rows(grams.shape[1], "float32")

    def __reduce__(self):
        return WordModel, (self.vocabulary, self.words, self.grams)

    @classmethod
    def fit(cls, names: list[str], table: np.ndarray, grams_of: tuple[np.ndarray, np.ndarray] | None = None) -> WordModel:
        """names: distinct words; table: their (fractional) counts under each class; grams_of: ``gram_places`` of the names."""
        n, size = table.shape[1], 1 << TRIGRAM_BITS
        place, owner = grams_of or gram_places(names)
        at = np.flatnonzero(table.sum(1) >= 2.0)
        known, words = {names[i]: k for k, i in enumerate(at.tolist())}, table[at]
        # types and tokens both count
        grams = np.stack([np.bincount(place, weights=np.sqrt(table[:, k])[owner], minlength=size) for k in range(n)], axis=1)
        sums = np.maximum(table.sum(0), 1.0)
        shared = words.sum(1, keepdims=True) / sums.sum()
        words = np.log(0.95 * words / sums + 0.002 * shared + 2e-7)
        sums = np.maximum(grams.sum(0), 1.0)
        natural = grams[:, : n - 1].sum(1, keepdims=True) / max(1.0, grams[:, : n - 1].sum())
        mixed = 0.9 * grams / sums + 0.03 * natural + 0.002 / size
        mixed[:, n - 1] = 0.6 * grams[:, n - 1] / sums[n - 1] + 0.4 / 27_000
        return cls(known, words.astype("float32"), np.log(mixed).astype("float32"))

    def scores(self, names: list[str], grams_of: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """A row of scores for each clean word."""
        place, owner = grams_of or gram_places(names)
        s = np.zeros((len(names), self.grams.shape[1]), "float32")
        if len(place):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            s[owner[first]] = self.TEMPER * np.add.reduceat(self.grams[place], first, axis=0)
        at = np.array([self.vocabulary.get(w, -1) for w in names], dtype="int64")
        old = at >= 0
        s[old] = 0.5 * s[old] + self.words[at[old]]
        s[~old] -= np.float32(4.0)
        s[~old, -1] += np.float32(1.0)
        return np.maximum(s, s.max(1, keepdims=True, initial=-np.inf) - 14.0)  # no single word decides alone

    def matrix(self, words: list[str]) -> np.ndarray:
        """Rows of scores, zero for what isn't a letter word (told by its second return value)."""
        memo = self.memo
        if len(memo) > 300_000:
            memo.clear()
            self.rows.clear()
        new = [w for w in words if w not in memo]
        letters = [w for w in new if letter_word(w)]
        memo.update(dict.fromkeys(new, -1))
        for start in range(0, len(letters), 20_000):
            part = letters[start : start + 20_000]
            memo.update(zip(part, self.rows.extend(self.scores([clean(w) for w in part])), strict=True))
        return np.array([memo[w] for w in words], dtype="int64")


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all words, the distinct words, and the number of words of each text; split at blanks, tabs and newlines."""
    lists = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), "[ \t\n]+")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = pc.list_flatten(lists).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), lengths


def best_paths(emit: np.ndarray, lengths: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi paths of many texts at once: emit has all words' rows in order, prior one row per text."""
    n, k = len(lengths), emit.shape[1]
    path = np.zeros(len(emit), dtype="int8")
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths, first = lengths[order], (np.cumsum(lengths) - lengths)[order]
    longest = int(sorted_lengths[0]) if n else 0
    if not longest:
        return path
    alive = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
    score, back = np.zeros((n, k), dtype="float32"), []
    enter = (prior[order] + switch).astype("float32")
    for t in range(longest):
        m = alive[t]
        rows = emit[first[:m] + t]
        if not t:
            score[:m] = prior[order][:m] + rows
            back.append(None)
            continue
        s = score[:m]
        best = s.argmax(1)
        jump = s[np.arange(m), best][:, None] + enter[:m]
        stay = s >= jump
        back.append((best.astype("int8"), stay))
        score[:m] = np.where(stay, s, jump) + rows
    state = score.argmax(1).astype("int8")
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        path[first[:m] + t] = state[:m]
        if t:
            best, stay = back[t]
            kept = stay[np.arange(m), state[:m]]
            state[:m] = np.where(kept, state[:m], best)
    return path


def segments(emit: np.ndarray, lengths: np.ndarray, path: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, ...]:
    """item, class, first word within the item, words and confidence of each run of one class."""
    if not len(path):
        return (np.zeros(0, "int64"),) * 4 + (np.zeros(0, "float32"),)
    item = np.repeat(np.arange(len(lengths)), lengths)
    cut = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (item[1:] != item[:-1])])
    n = np.diff(np.r_[cut, len(path)])
    sums = np.add.reduceat(emit.astype("float64"), cut, axis=0)
    total = 0.4 * sums + prior[item[cut]]
    total -= total.max(1, keepdims=True)
    p = np.exp(total)
    chosen = path[cut].astype("int64")
    confidence = p[np.arange(len(cut)), chosen] / p.sum(1)
    return item[cut], chosen, cut - (np.cumsum(lengths) - lengths)[item[cut]], n, confidence.astype("float32")


def classify(model: WordModel, texts: pa.Array, prior: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Segments of each text over its letter words, and the number of its letter words."""
    codes, words, lengths = words_of(texts)
    at = model.matrix(words)[codes] if len(words) else np.zeros(0, "int64")
    item = np.repeat(np.arange(len(lengths)), lengths)
    kept = at >= 0
    n_letter = np.bincount(item[kept], minlength=len(lengths)).astype("int64")
    emit = model.rows.at(at[kept])
    path = best_paths(emit, n_letter, prior)
    return segments(emit, n_letter, path, prior), n_letter


# ---- training


@lru_cache(maxsize=1 << 18)
def word_facts(word: str) -> tuple[str, int, bool, bool]:
    """The clean form of a letter word (else an empty one), its letters, whether it is a longer Latin word, and one without vowels."""
    w = clean(word)
    letters = len(LETTERS.findall(w))
    latin = letters >= 2 and w.isascii() and len(w) >= 4
    return (w if letters >= 2 else ""), letters, latin, latin and not VOWELS.search(w)


def line_words(line: str) -> tuple[list[str], bool]:
    """Clean letter words of a line and whether it may teach a natural language: no line of one repeated word, of symbols or of words without vowels."""
    pieces = line.split()
    facts = [f for f in map(word_facts, pieces) if f[0]]
    words = [f[0] for f in facts]
    good = bool(words) and not (len(words) >= 4 and len(set(words)) * 2 < len(words))
    good = good and sum(f[1] for f in facts) >= 0.6 * sum(map(len, pieces))
    return words, good and sum(f[3] for f in facts) * 4 <= max(sum(f[2] for f in facts), 1)


def fit(sample: list[tuple[str, list[str]]], rounds: int = 3) -> WordModel:
    """Learn from (text, label languages): lines vote for their text's label, then for what the model finds, and so on.

    Wrong labels put words of a large language into a small one, where a few of them outweigh the small language's own words. So
    the first counts of a word leave out of each language what the label error alone explains (LABEL_ERROR of all its counts).
    """
    lines: list[tuple[Counter, list[str], bool]] = []
    weights: list[float] = []
    for text, langs in sample:
        before = len(lines)
        for line in text.split("\n"):
            words, good = line_words(line)
            if words:
                lines.append((Counter(words), [x for x in langs if x in LANGUAGES], good))
        n = sum(sum(words.values()) for words, _, _ in lines[before:])
        weights += [min(1.0, TEXT_WORDS / n)] * (len(lines) - before) if n else []
    soft = np.zeros((len(lines), len(CLASSES)))
    for i, (_, langs, good) in enumerate(lines):
        if not good:
            soft[i, -1] = 1.0
        elif langs:
            soft[i, [LANGUAGES.index(x) for x in langs]] = 1 / len(langs)
    vocabulary = {w: k for k, w in enumerate({w: 0 for words, _, _ in lines for w in words})}
    flat = np.array([vocabulary[w] for words, _, _ in lines for w in words], dtype="int64")
    value = np.array([v for words, _, _ in lines for v in words.values()], dtype="float64")
    owner = np.repeat(np.arange(len(lines)), [len(words) for words, _, _ in lines])
    weight = np.array(weights)[owner] * value if lines else value
    bad = np.array([not good for _, _, good in lines], dtype=bool)
    declared = np.log(np.where(soft > 0, 1 - LABEL_ERROR, LABEL_ERROR / len(CLASSES)))
    declared[soft.sum(1) == 0] = 0
    names, model = list(vocabulary), None
    grams_of = gram_places(names)
    for turn in range(rounds):
        table = np.zeros((len(vocabulary), len(CLASSES)))
        for k in range(len(CLASSES)):
            table[:, k] = np.bincount(flat, weights=weight * soft[owner, k], minlength=len(vocabulary))
        if not turn:
            natural = table[:, : len(LANGUAGES)]
            natural -= np.minimum(natural, LABEL_ERROR * natural.sum(1, keepdims=True))
        model = WordModel.fit(names, table, grams_of)
        emit = model.scores(names, grams_of)
        sums = np.stack([np.bincount(owner, weights=emit[flat, k] * value, minlength=len(lines)) for k in range(len(CLASSES))], axis=1)
        sums = 0.5 * sums + declared
        sums -= sums.max(1, keepdims=True, initial=-np.inf)
        soft = np.exp(sums)
        soft /= soft.sum(1, keepdims=True)
        soft[bad] = np.eye(len(CLASSES))[-1]
    return model


def sampled(items: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str, list[str]]]:
    """(src, text, label languages) of about ``rows`` labelled texts per item set, up to SAMPLE_CHARS characters of each set.

    Ids whose hash is under a threshold are taken, so tasks send no more than what is used, whatever their number. A set's texts
    count in hash order until they reach the total; a text that alone exceeds it isn't taken.
    """
    labelled = items.filter((F.size("declared") > 0) & F.col("text").isNotNull())
    h = F.pmod(F.xxhash64(F.col("item_id"), F.lit(7)), F.lit(1 << 40))
    counts = {r[0]: r[1] for r in small_rows(labelled.groupBy("src").count(), "item sets", 100)}
    share = lambda n: F.lit(int(min(1.0, rows / n) * (1 << 40)))
    taken = F.lit(False)
    for src, n in counts.items():
        taken = taken | ((F.col("src") == src) & (h < share(n)))
    picked = labelled.filter(taken & (F.length("text") <= SAMPLE_CHARS)).select("src", h.alias("h"), "item_id", "text", "declared").limit(2 * rows * max(len(counts), 1))
    out, chars = [], Counter()
    for r in sorted(picked.toLocalIterator(), key=lambda r: (r["src"], r["h"], r["item_id"], r["text"])):
        chars[r["src"]] += len(r["text"])
        if chars[r["src"]] <= SAMPLE_CHARS:
            out.append((r["src"], r["text"], list(r["declared"])))
    return out


def train(items: DataFrame, rows: int = SAMPLE_ROWS) -> WordModel:
    """Fit on the sample of labelled texts."""
    return fit([(text, langs) for _, text, langs in sampled(items, rows)])


# ---- priors


def host_priors(items: DataFrame) -> DataFrame:
    """src, kind, host -> prior: log prior over CLASSES, from declared labels, each level smoothed by the one above."""
    one = items.filter(F.size("declared") > 0).select("src", "kind", "host", F.explode("declared").alias("lang")).filter(F.col("lang").isin(*LANGUAGES))
    counts = one.groupBy("src", "kind", "host").agg(*[F.sum((F.col("lang") == x).cast("double")).alias(f"c_{x}") for x in LANGUAGES])
    hosts = items.select("src", "kind", "host").distinct()

    def level(keys: list[str], name: str) -> DataFrame:
        return counts.groupBy(*keys).agg(*[F.sum(f"c_{x}").alias(f"{name}_{x}") for x in LANGUAGES])

    flat = 1.0 / len(LANGUAGES)
    out = hosts.join(counts, ["src", "kind", "host"], "left").join(level(["src"], "s"), ["src"], "left").join(level(["src", "kind"], "k"), ["src", "kind"], "left")

    def smoothed(prefix: str, x: str, above: Column) -> Column:
        total = sum((F.coalesce(F.col(f"{prefix}_{y}"), F.lit(0.0)) for y in LANGUAGES), F.lit(0.0))
        return (F.coalesce(F.col(f"{prefix}_{x}"), F.lit(0.0)) + PRIOR_WEIGHT * above) / (total + PRIOR_WEIGHT)

    logs = [F.log(F.lit(0.02 / len(CLASSES)) + 0.95 * smoothed("c", x, smoothed("k", x, smoothed("s", x, F.lit(flat))))) for x in LANGUAGES]
    return out.select("src", "kind", "host", F.array(*logs, F.log(F.lit(0.03))).alias("prior"))


def label_evidence(declared: list[str] | None) -> np.ndarray:
    out = np.zeros(len(CLASSES))
    named = [LANGUAGES.index(x) for x in declared or () if x in LANGUAGES]
    if named:
        out[:] = np.log(LABEL_ERROR / len(CLASSES))
        out[named] = np.log((1 - LABEL_ERROR) / len(named))
        out[-1] = np.log(LABEL_ERROR)
    return out


def identify(items: DataFrame, model: WordModel | None = None) -> DataFrame:
    """items(src, item_id, text, label, kind, host) -> src, item_id, declared, n_letter_words, languages, segments.

    languages: sorted codes with at least MIN_RUN letter words in a row, empty for unreadable, empty and very short texts; segments:
    all runs, whatever their length, counted in letter words (class ``zxx`` is unreadable). Null texts count as empty, null hosts
    and kinds as a host of their own; repeated ids give a row each; other columns are left out. An empty table gives an empty one.
    """
    items = items.select("src", F.col("item_id").cast("long").alias("item_id"), "text", label_languages(F.col("label")).alias("declared"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("host", F.lit("")).alias("host"))
    spark = items.sparkSession
    model = model or train(items)
    shared = spark.sparkContext.broadcast(model)
    priors = host_priors(items)
    found = priors.take(MAX_HOSTS + 1)
    known = spark.sparkContext.broadcast({(r[0], r[1], r[2]): np.array(r[3]) for r in found}) if len(found) <= MAX_HOSTS else None
    if known is None:
        items = items.join(priors, ["src", "kind", "host"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, even = shared.value, np.log(np.full(len(CLASSES), 1.0 / len(CLASSES)))
        for batch in bounded(batches):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            declared = col["declared"].to_pylist()
            if known is None:
                host = [even if p is None else np.array(p) for p in col["prior"].to_pylist()]
            else:
                keys = zip(col["src"].to_pylist(), col["kind"].to_pylist(), col["host"].to_pylist(), strict=True)
                host = [known.value.get(k, even) for k in keys]
            memo: dict[tuple, np.ndarray] = {}
            prior = np.zeros((len(declared), len(CLASSES)))
            for i, (langs, h) in enumerate(zip(declared, host, strict=True)):
                key = tuple(langs or ())
                if key not in memo:
                    memo[key] = label_evidence(langs)
                prior[i] = memo[key] + h
            (item, chosen, first, n, confidence), letters = classify(model, col["text"], prior)
            starts = np.searchsorted(item, np.arange(len(declared) + 1)).astype("int32")
            names = np.array(CLASSES, dtype=object)
            counted = (n >= MIN_RUN) & (chosen < len(LANGUAGES))
            langs = [[] for _ in declared]
            for i, c in zip(item[counted].tolist(), chosen[counted].tolist(), strict=True):
                langs[i].append(CLASSES[c])
            runs = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(names[chosen].tolist(), pa.string()), pa.array(first.astype("int32")), pa.array(n.astype("int32")), pa.array(confidence)], ["lang", "first_word", "n_words", "confidence"]))
            yield pa.RecordBatch.from_arrays(
                [col["src"], col["item_id"], col["declared"], pa.array(letters), pa.array([sorted(set(x)) for x in langs], pa.list_(pa.string())), runs],
                ["src", "item_id", "declared", "n_letter_words", "languages", "segments"],
            )

    return items.mapInArrow(run, f"src string, item_id long, declared array<string>, n_letter_words long, languages array<string>, segments {segment_schema()}")


def mislabelled(identified: DataFrame, min_words: int = 12) -> DataFrame:
    """src, item_id, lang of items with enough letter words whose label names other languages than the text; a row per language."""
    wrong = identified.filter((F.col("n_letter_words") >= min_words) & ~F.col("declared").eqNullSafe(F.col("languages")))
    return wrong.select("src", "item_id", F.explode("languages").alias("lang"))
