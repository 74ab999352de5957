import random

import pytest
from pyspark.sql import functions as F

from pageloom.llm import mixing, packing, token_budget
from pageloom.llm.common import GreedyTokenizer, label_languages, load_tokenizer, token_size

PIECES = ["▁", "▁a", "▁ab", "b", "c", "abc"]


def slow_size(text, pieces):
    n = 0
    for word in [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]:
        s = "▁" + word
        while s:
            best = max((p for p in pieces if s.startswith(p)), key=len, default=s[0])
            s, n = s[len(best) :], n + 1
    return n


def test_greedy_sizes(spark):
    t, r = GreedyTokenizer(PIECES, memo=5), random.Random(1)
    for _ in range(500):
        text = "".join(r.choice("abcx \t\n") for _ in range(r.randint(0, 30)))
        assert t.size(text) == slow_size(text, PIECES)
    assert t.size(None) == 0 and t.size("x" * 100_000) == 100_001
    vocab = spark.createDataFrame([(1, "a", "special"), (2, "▁a", "text"), (3, None, "text"), (4, "", "text"), (5, "▁a", "text")], "piece_id int, piece string, kind string")
    tok = load_tokenizer(vocab)
    assert tok.pieces == {"▁a"}
    got = spark.createDataFrame([("aa a",), (None,), ("",)], "t string").select(token_size(tok, spark)("t").alias("n")).collect()
    assert [r["n"] for r in got] == [3, 0, 0]


@pytest.mark.parametrize("label, codes", [("en", ["en"]), (" en", ["en"]), ("en_US", ["en"]), ("fre", ["fr"]), ("German", ["de"]), ("en+fr", ["en", "fr"]), ("fr/en", ["en", "fr"]), ("pt-PT", ["pt"]), ("und", []), ("unknown", []), ("", []), (None, []), ("EN+en", ["en"]), ("ja", ["ja"])])
def test_labels(spark, label, codes):
    assert spark.createDataFrame([(label,)], "l string").select(label_languages(F.col("l")).alias("c")).first()["c"] == codes


def test_budget_deltas_equal_a_fresh_run(spark):
    tok = GreedyTokenizer(PIECES)
    schema = "rec_id long, text string, source string, lang string, domain string"
    old = spark.createDataFrame([(1, "a b", "s", "en", "d"), (2, "abc", "s", "en", "d"), (3, None, "t", "fr", "d"), (4, "a", "u", "en", "d")], schema)
    new = spark.createDataFrame([(1, "a b", "s", "en", "d"), (2, "abc abc", "s", "en", "d"), (3, None, "t", "fr", "e"), (5, "a b", "s", "en", "d")], schema)
    before = token_budget.count_tokens(old, tok)
    counts = token_budget.count_table(before, tok)
    assert counts.count() == 4
    after = token_budget.count_tokens(new, tok, counts)
    changed = token_budget.apply_deltas(token_budget.cube(before), token_budget.deltas(before, after, "rec_id"))
    rows = lambda df: sorted(map(tuple, df.select("source", "lang", "domain", "n_records", "n_tokens").collect()))
    assert rows(changed) == rows(token_budget.cube(token_budget.count_tokens(new, tok)))
    assert token_budget.count_table(after, tok, counts).count() == 5
    assert token_budget.rollup(token_budget.cube(before)).filter("source is null and lang is null and domain is null").first()["n_records"] == 4
    assert token_budget.cube(token_budget.count_tokens(old.limit(0), tok)).count() == 0


def test_slices(spark):
    m = spark.createDataFrame([(1, "a", "EN", " Letter "), (2, "a", None, None), (3, "a", "en", "x"), (None, "a", "en", "x")], "rec_id long, ref string, lang string, domain string").withColumn("source", F.lit("clash"))
    s = spark.createDataFrame([(1, " PDFA:key"), (1, "pdfa:key"), (2, "  "), (2, "idl_x/1"), (3, None), (9, "x:1")], "rec_id long, source string")
    records, families = token_budget.sliced_records(m, s)
    got = {r["rec_id"]: tuple(r[c] for c in token_budget.SLICE) for r in records.join(families, "rec_id").collect()}
    assert got == {1: ("pdfa", "en", "letter"), 2: ("idl_x", "und", "unknown")}
    needs = spark.createDataFrame([("pdfa", "en", "letter", 100.0), ("none", "en", "x", 0.5), ("none", "en", "y", 0.0)], "source string, lang string, domain string, need_per_mille double")
    cube = spark.createDataFrame([("pdfa", "en", "letter", 1, 90), ("o", "o", "o", 1, 910)], "source string, lang string, domain string, n_records long, n_tokens long")
    assert sorted(r["domain"] for r in token_budget.short_slices(cube, needs).collect()) == ["letter", "x"]


def slow_pack(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_best_fit_equals_one_by_one():
    r = random.Random(2)
    for _ in range(300):
        capacity = r.randint(3, 40)
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        runs, opened = packing.best_fit({s: sizes.count(s) for s in sizes}, capacity)
        assert opened == slow_pack(sizes, capacity)
        used = {}
        for size, _, n, first in runs:
            for k in range(n):
                used[first + k] = used.get(first + k, 0) + size
        assert all(v <= capacity for v in used.values()) and sum(used.values()) == sum(sizes)


def test_pack(spark):
    r = random.Random(3)
    items = [(k, r.choice([7, 7, 7, 3, 12, 45, 0, 101])) for k in range(800)] + [(900, None), (7, 7)]
    df = spark.createDataFrame(items, "item_id long, n_tokens long").withColumn("container_no", F.lit("clash"))
    got = packing.pack(df, 20).collect()
    assert sum(r["piece_tokens"] for r in got) == sum(n or 0 for _, n in items)
    used = {}
    for row in got:
        if row["container_no"] is not None:
            used[row["container_no"]] = used.get(row["container_no"], 0) + row["piece_tokens"]
    assert max(used.values()) <= 20 and sorted(used) == list(range(len(used)))
    assert {r["item_id"] for r in got if r["n_pieces"] > 1} == {k for k, n in items if n and n > 20}
    cut = [min(20, n - 20 * j) for _, n in items if n for j in range(-(-n // 20))]
    assert len(used) == slow_pack(cut, 20)
    assert packing.fill_report(packing.pack(df, 20), 20).first()["n_containers"] == len(used)
    assert packing.pack(df.limit(0), 20).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_flight_keeps_totals():
    import numpy as np

    r = np.random.default_rng(1)
    size, p = r.integers(1, 500, 3000), np.full(3000, 0.37)
    x = mixing.flight(p, np.sort(size), 5)
    open_units = (x > 0) & (x < 1)
    assert open_units.sum() <= 2 and abs(x.sum() - p.sum()) < 1e-6 and abs((x * np.sort(size)).sum() - (p * size).sum()) < 1e-3
    assert set(mixing.flight(p, np.sort(size), 5, True)) == {0.0, 1.0}
    assert abs(np.mean([mixing.flight(np.full(40, 0.25), np.arange(1, 41), s, True)[7] for s in range(400)]) - 0.25) < 0.08


def test_mix(spark):
    r = random.Random(4)
    docs = [(k, " A " if k % 2 else "b", r.randint(1, 60)) for k in range(6000)] + [(9001, "tiny", 50), (9002, None, 5), (9003, "b", None)]
    df = spark.createDataFrame(docs, "item_id long, source string, n_tokens long")
    recipe = spark.createDataFrame([("m", "a", 3.0, 2), ("m", "b", 1.0, 1), ("m", "tiny", 1.0, 3), ("m", "zero", 0.0, None), ("m", "gone", 1.0, 5), ("other", "a", 1.0, 1)], "mix_name string, source string, weight double, max_repeats int")
    chosen, report = mixing.mix(df, recipe, group_rows=500)
    rows = {(r["mix_name"], r["source"]): r for r in report.collect()}
    assert {k for k, r in rows.items() if r["short"]} == {("m", "tiny"), ("m", "gone")}
    for key in (("m", "a"), ("m", "b")):
        assert abs(rows[key]["reached_tokens"] - rows[key]["wanted_tokens"]) <= 120
    assert rows["m", "tiny"]["reached_tokens"] == 150 and rows["m", "zero"]["reached_tokens"] == 0 and rows["m", "gone"]["reached_tokens"] == 0
    assert rows["other", "a"]["reached_docs"] == 3000
    caps = {"a": 2, "b": 1, "tiny": 3}
    assert all(r["copies"] <= caps[r["source"]] for r in chosen.filter("mix_name = 'm'").collect())
    assert mixing.mix(df.limit(0), recipe)[0].count() == 0 and mixing.mix(df, recipe.limit(0))[1].count() == 0


def test_budget_state_equals_a_fresh_run(spark):
    tok, r = GreedyTokenizer(PIECES), random.Random(8)
    schema = "rec_id long, text string, lang string, domain string"
    make = lambda ids: [(k, r.choice(["a b", "abc", None, "", "a b abc"]), r.choice(["en", "fr"]), r.choice(["x", "y"])) for k in ids]
    first, second = make(range(40)), make(range(20, 60))
    one, two = spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    fam = spark.createDataFrame([(k, "s" if k % 2 else "t") for k in range(60) if k % 5], "rec_id long, source string")
    rows = lambda df: sorted(map(tuple, df.select("source", "lang", "domain", "n_records", "n_tokens").collect()))
    a = token_budget.Budget.empty(spark).updated(one, fam, tok)
    b = a.updated(two, fam.filter("rec_id <> 41"), tok)
    for state, data, families in ((a, one, fam), (b, two, fam.filter("rec_id <> 41"))):
        assert rows(state.slices) == rows(token_budget.cube(token_budget.count_tokens(data, tok).join(families, "rec_id")))
    assert a.counts.count() == b.counts.count() == len({x[1] or "" for x in first})  # each content is encoded once, null as empty
    assert token_budget.Budget.empty(spark).updated(one.limit(0), fam, tok).slices.count() == 0
    assert b.updated(two.limit(0), fam, tok).slices.count() == 0


def test_hot_sizes_are_ranked_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(k, 5 if k % 3 else 7) for k in range(600)], "item_id long, n_tokens long")
    whole = sorted(map(tuple, packing.pack(df, 12).groupBy("container_no").agg(F.sum("piece_tokens").alias("n"), F.count("*").alias("k")).collect()))
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    parts = packing.pack(df, 12)
    assert sorted(map(tuple, parts.groupBy("container_no").agg(F.sum("piece_tokens").alias("n"), F.count("*").alias("k")).collect())) == whole
    assert parts.count() == 600 and packing.pack(df, 1_000_000).select("container_no").distinct().count() == 1


def test_split_join(spark):
    from pageloom.llm.common import split_join

    a = spark.createDataFrame([(k, k % 3) for k in range(30)], "x long, k long")
    b = spark.createDataFrame([(k, 1 if k % 2 else k % 5) for k in range(40)], "y long, k long")
    assert sorted(map(tuple, split_join(a, b, "k", "y", rows=4).select("x", "y", "k").collect())) == sorted(map(tuple, a.join(b, "k").select("x", "y", "k").collect()))
