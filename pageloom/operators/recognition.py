"""Recognition metrics over rows of (key, ref, hyp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

CER_THRESHOLDS = (0.0, 0.1, 0.2, 0.3)


def doc_cer(ref: Column, hyp: Column) -> Column:
    """Character errors over the reference's length; 0 if both are empty, 1 if one is. Null reads as empty."""
    r, h = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    return F.when((r == "") & (h == ""), 0.0).when((r == "") | (h == ""), 1.0).otherwise(F.levenshtein(r, h) / F.length(r))


def char_errors(ref: Column, hyp: Column) -> Column:
    return F.levenshtein(F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit("")))


def as_letters(seq: Column, vocabulary: Column) -> Column:
    """A word sequence as a string with one code point per distinct word, so that an edit distance counts words."""
    letter = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 0x20000), 8, "0")), "UTF-32")
    return F.array_join(F.transform(seq, letter), "")


def word_errors(ref: Column, hyp: Column) -> Column:
    """Word edit distance on the JVM: words become code points (up to 900,000 distinct ones in a pair)."""
    pair = F.struct(t.words(ref).alias("r"), t.words(hyp).alias("h"))
    full = t.bound(pair, lambda p: F.struct(p["r"].alias("r"), p["h"].alias("h"), F.array_distinct(F.concat(p["r"], p["h"])).alias("v")))
    return t.bound(full, lambda p: F.levenshtein(as_letters(p["r"], p["v"]), as_letters(p["h"], p["v"])))


def corpus_cer(pairs: DataFrame) -> DataFrame:
    """One row: errors of all pairs over characters of all references; 0 without references."""
    n = F.sum(F.length(F.coalesce("ref", F.lit(""))))
    return pairs.agg(F.coalesce(F.sum(char_errors(F.col("ref"), F.col("hyp"))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("cer"))


def corpus_wer(pairs: DataFrame) -> DataFrame:
    n = F.sum(F.size(t.words(F.col("ref"))))
    return pairs.agg(F.coalesce(F.sum(word_errors(F.col("ref"), F.col("hyp"))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("wer"))


def word_matches(pairs: DataFrame, key: str) -> DataFrame:
    """key, tp, fp, fn of the multisets of words; one row per key, also for pairs without words."""
    side = lambda c, r, h: pairs.select(key, F.explode_outer(t.words(F.col(c))).alias("w"), F.lit(r).alias("r"), F.lit(h).alias("h"))
    counts = side("ref", 1, 0).unionByName(side("hyp", 0, 1)).groupBy(key, "w").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    real = F.col("w").isNotNull()
    both = F.least("r", "h")
    return counts.groupBy(key).agg(
        F.sum(F.when(real, both).otherwise(0)).alias("tp"),
        F.sum(F.when(real, F.col("h") - both).otherwise(0)).alias("fp"),
        F.sum(F.when(real, F.col("r") - both).otherwise(0)).alias("fn"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def word_prf(pairs: DataFrame, key: str) -> DataFrame:
    """One row: precision, recall and F1 over all documents' word multisets."""
    sums = word_matches(pairs, key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def cer_ap(pairs: DataFrame, thresholds=CER_THRESHOLDS) -> DataFrame:
    """threshold, ap: share of documents whose error rate is at most the threshold (higher is better)."""
    cer = pairs.select(doc_cer(F.col("ref"), F.col("hyp")).alias("cer"))
    sums = cer.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("cer") <= x).cast("int")).alias(f"t{k}") for k, x in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), ratio(F.coalesce(F.col(f"t{k}"), F.lit(0)), F.col("n")).alias("ap")) for k, x in enumerate(thresholds)])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def empty_hypotheses(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(t.blank(F.col("hyp"))).alias("n_empty"))


def summary(pairs: DataFrame, key: str) -> DataFrame:
    """One row with corpus error rates, word F1 and empty hypotheses."""
    return corpus_cer(pairs).crossJoin(corpus_wer(pairs)).crossJoin(word_prf(pairs, key)).crossJoin(empty_hypotheses(pairs))  # one row each
