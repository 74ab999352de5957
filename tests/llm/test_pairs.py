import random
import re

from pyspark.sql import functions as F

from pageloom.llm import near_dup, overlap, shingles


def sets_of(rows):
    out = {}
    for i, text in rows:
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        if len(w) >= 15 and len(set(w)) >= 10:
            out[i] = set(zip(w, w[1:], w[2:], strict=False))
    return out


def slow_pairs(rows):
    s = sets_of(rows)
    return {(a, b) for a in s for b in s if a < b and 2 * len(s[a] & s[b]) >= max(len(s[a]), len(s[b]))}


def corpus(n=160, seed=1):
    r, rows = random.Random(seed), []
    words = [f"w{k}" for k in range(120)] + ["Ärger", "ÉTÉ", "été", "x_y", "a.b"]
    for k in range(n):
        if rows and r.random() < 0.5:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(0, max(1, len(w) // 6))):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2)
            if r.random() < 0.2:
                h = len(w) // 2
                w = w[h:] + w[:h]
            text = r.choice([" ", "\n", " - "]).join(w)
        else:
            text = " ".join(r.choice(words) for _ in range(r.choice([5, 14, 15, 30, 60, 150, 400])))
        rows.append((k, text if r.random() < 0.8 else text.upper()))
    return [*rows, (1000, None), (1001, ""), (1002, "  "), (1003, "same " * 50), (1004, "same " * 50)]


def test_words_and_bitmaps_bound_the_sets():
    import numpy as np
    import pyarrow as pa

    rows = corpus(80, 5)
    s = shingles.shingle(pa.array([t for _, t in rows]))
    at = shingles.distinct_by(s, np.zeros(len(s.hash), "uint8"))
    sets, n = sets_of(rows), np.bincount(s.text[at], minlength=len(rows))
    assert [int(n[k]) for k, _ in enumerate(rows)] == [len(sets.get(i, ())) for i, _ in rows]
    far = shingles.word_hashes(pa.array(["字 Ａb ａB", None, "字"]))
    assert far[1].tolist() == [3, 0, 1] and far[0][0] == far[0][3] and far[0][1] == far[0][2]


def test_near_duplicates_lose_no_pair(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, text string").withColumn("rep", F.lit("clash"))
    links, members = near_dup.near_duplicates(df)
    pairs = near_dup.expanded(links, members, near_dup.comparable(df, members)).collect()
    got = {(r["rec_id_a"], r["rec_id_b"]) for r in pairs}
    assert got == slow_pairs(rows) and len(got) == len(pairs)
    assert members.count() == len(rows) and near_dup.grouped(links, members).filter("n_links > 0").count() > 0


def test_near_duplicates_of_a_hot_class_and_of_nothing(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(k, text) for k in range(400)] + [(500 + k, text + f" tail{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "id long, text string")
    links, members = near_dup.near_duplicates(df)
    assert links.count() == 21 * 20 // 2 and members.filter("rep = 0").count() == 400
    links, members = near_dup.near_duplicates(df.limit(0))
    assert links.count() == 0 and members.count() == 0


def test_cross_split_loses_no_pair(spark):
    rows, r = corpus(200, 9), random.Random(2)
    splits = {i: r.choice(["train", " TRAIN", "val", "Test ", "dev", "validation", None, "other"]) for i, _ in rows}
    df = spark.createDataFrame([(i, t, splits[i], r.choice([None, f"/x/p{i % 40}.PNG", f"y\\P{i % 40}.jpg", "", "noend"])) for i, t in rows], "id long, text string, split string, image string")
    side = lambda s: "t" if s and s.strip().lower() == "train" else "e" if s and s.strip().lower() in ("val", "test", "dev", "validation") else None
    wanted = {(a, b) for a, b in slow_pairs(rows) if {side(splits[a]), side(splits[b])} == {"t", "e"}}
    links, members = overlap.cross_split(df)
    got = {tuple(sorted((r["eval_id"], r["train_id"]))) for r in overlap.text_pairs(links, members).collect()}
    assert got == wanted
    images = {i: v for i, v in ((x["id"], x["image"]) for x in df.collect())}
    name = lambda v: None if not v else re.sub(r"(?<=.)\.[^.]*$", "", re.split(r"[/\\]", v)[-1]).lower()
    same = {tuple(sorted((a, b))) for a in images for b in images if name(images[a]) and name(images[a]) == name(images[b]) and side(splits[a]) == "e" and side(splits[b]) == "t"}
    assert {tuple(sorted((r["eval_id"], r["train_id"]))) for r in overlap.image_pairs(df).collect()} == same
    found = overlap.report(df.withColumn("source", F.lit("s")), links, members).agg(F.sum("n_records"), F.sum("n_overlap")).first()
    assert found[0] == sum(side(s) == "e" for s in splits.values()) and found[1] == len({i for p in wanted | same for i in p if side(splits[i]) == "e"})
    links, members = overlap.cross_split(df.limit(0))
    assert links.count() == 0 and members.count() == 0
