import random

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import language_id, line_kinds, reading_level

WORDS = {
    "en": "the window of this house was opened by our neighbour before every morning because nobody had the key and they would like to see their garden".split(),
    "fr": "la fenêtre de cette maison était ouverte par notre voisine avant chaque matin parce que personne ne trouvait les clés et ils voudraient voir leur jardin".split(),
    "de": "das fenster dieses hauses wurde von unserem nachbarn jeden morgen geöffnet weil niemand den schlüssel hatte und sie möchten ihren garten sehen".split(),
}


def text(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def languages():
    r = random.Random(1)
    sample = []
    for _ in range(300):
        lang = r.choice(list(WORDS))
        label = lang if r.random() < 0.85 else r.choice(list(WORDS))
        sample.append(("\n".join(text(r, lang, 9) for _ in range(4)), [label]))
    sample += [("\n".join(" ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(8)) for _ in range(4)), ["en"]) for _ in range(20)]
    return language_id.fit(sample)


def test_language_runs(spark, languages):
    r = random.Random(2)
    rows = [
        (1, text(r, "en", 40), "fr"), (2, text(r, "en", 30) + " " + text(r, "de", 30), "en"), (3, text(r, "fr", 30) + " " + text(r, "en", 4) + " " + text(r, "fr", 30), "fr"),
        (4, "", "en"), (5, None, None), (6, "qxrk tzhrx nzvnvw jvngllh gzwzkzg vjz wjzjnkkqt lzh xjt xrggjr jtqzl jxqj hwnk", "en"), (7, text(r, "de", 5), None), (8, text(r, "de", 20_000), "de"), (8, text(r, "fr", 20), None),
    ]
    df = spark.createDataFrame([("x", *row, None, "h") for row in rows], "src string, item_id long, text string, label string, kind string, host string")
    df = df.withColumnRenamed("host", "host").selectExpr("*", "'clash' as languages")
    got = [(x["item_id"], x["languages"]) for x in language_id.identify(df, languages).collect()]
    assert sorted(got) == [(1, ["en"]), (2, ["de", "en"]), (3, ["fr"]), (4, []), (5, []), (6, []), (7, []), (8, ["de"]), (8, ["fr"])]
    wrong = sorted((x["item_id"], x["lang"]) for x in language_id.mislabelled(language_id.identify(df, languages)).collect())
    assert wrong == [(1, "en"), (2, "de"), (2, "en"), (8, "fr")]
    segments = next(x for x in language_id.identify(df, languages).collect() if x["item_id"] == 2)["segments"]
    assert [s["lang"] for s in segments] == ["en", "de"] and all(0.9 < s["confidence"] <= 1 for s in segments) and abs(segments[0]["n_words"] - 30) <= 2
    assert language_id.identify(df.limit(0), languages).count() == 0


def test_paths_equal_one_by_one():
    r = np.random.default_rng(3)
    lengths = np.array([0, 5, 1, 9, 3])
    emit, prior = r.normal(0, 3, (lengths.sum(), 3)).astype("float32"), np.log(r.dirichlet([1, 1, 1], 5))
    got, at = language_id.best_paths(emit, lengths, prior, -2.0), 0
    for k, n in enumerate(lengths):
        best = None
        for path in np.ndindex(*[3] * n):
            score = sum(emit[at + t, s] for t, s in enumerate(path)) + (prior[k, path[0]] if n else 0)
            score += sum(prior[k, b] - 2.0 for a, b in zip(path, path[1:], strict=False) if a != b)
            if best is None or score > best[0]:
                best = (score, path)
        assert tuple(got[at : at + n]) == best[1]
        at += n


def sample_page(r, kind):
    n = r.randint(4, 14)
    if kind == "prose":
        words = text(r, r.choice(list(WORDS)), 12 * n).split()
        for k in range(9, len(words), 11):
            words[k] += "."
        out, line = [], ""
        for w in words:
            if len(line) + len(w) > 60:
                out.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        return "\n".join([*out, line])
    if kind == "list":
        mark = r.choice(["- ", "* ", "{k}. ", "{k}) ", "• "])
        return "\n".join(mark.format(k=k) + " ".join(r.sample(WORDS["en"], 2)) for k in range(1, n + 1))
    if kind == "table":
        return "\n".join(f"{r.choice(WORDS['en'])} {r.choice(WORDS['en'])} | {r.randint(1, 99)} | {r.random() * 100:.2f}" for _ in range(n))
    return "\n".join("".join(r.choice("#~^*<>=_\\/`|'") for _ in range(40)) for _ in range(n))


def test_line_kinds(spark):
    r = random.Random(5)
    kinds = [r.choice(line_kinds.KINDS) for _ in range(240)]
    labels = [k if r.random() < 0.9 else r.choice(line_kinds.KINDS) for k in kinds]
    model = line_kinds.fit([sample_page(r, k) for k in kinds], labels)
    held = [(k, sample_page(r, line_kinds.KINDS[k % 4])) for k in range(80)]
    mixed = sample_page(r, "prose") + "\n" + sample_page(r, "prose") + "\n- one\n- two\n- three"
    rows = [("d", k, t, None) for k, t in held] + [("d", 900, mixed, None), ("d", 901, None, None), ("d", 902, " \n ", 7), ("d", 903, "x" * 100_000, None)]
    df = spark.createDataFrame(rows, "src string, item_id long, text string, n_units long")
    got = {x["item_id"]: x for x in line_kinds.describe(df, model).collect()}
    assert sum(got[k]["kind"] == line_kinds.KINDS[k % 4] for k, _ in held) >= 77
    assert got[900]["kind"] == "prose" and got[901]["kind"] is None and got[901]["n_lines"] == 0 and got[902]["n_lines"] == 7
    page = got[0]
    assert page["n_words"] == len(held[0][1].split()) and len(page["line_kinds"]) == page["n_lines"] and abs(sum(page[k] for k in line_kinds.KINDS) - 1) < 1e-9
    assert line_kinds.describe(df.limit(0), model).count() == 0


def test_training_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text here.")], "item_id long, text string")
    labels = spark.createDataFrame([(1, "prose"), (1, "list"), (7, "junk"), (1, None)], "doc_id long, kind string")
    assert line_kinds.train(docs, labels).tables and line_kinds.train(docs, labels.limit(0)).tables


ANCHORS = [
    (1, "The cat sat on a mat. The dog ran to him. A boy has a red hat."), (1, "My hen is big. The sun was hot. We sat by the old log."),
    (2, "Their cousin will collect the parcel before noon, because nobody moved the ladder. The weekly market was closed."), (2, "Our neighbour painted the kitchen after the meeting. Every printed letter was checked, since they lost the folder."),
    (3, "The considerable recommendation of the committee, which had documented the provisional expenditure, established the professional organisation."), (3, "The technical investigation transferred the additional documentation, whereas the residential association had analysed the requirement."),
]


def test_reading_levels(spark, languages):
    ranker = reading_level.Ranker.fit(ANCHORS)
    for level, t in ANCHORS:
        found = ranker.level_of(reading_level.sentences(t.split("\n")))
        assert np.bincount(found, minlength=4).argmax() == level
    assert reading_level.sentences(["A broken tele-", "phone rang. Then it", "stopped."]) == [["A", "broken", "telephone", "rang"], ["Then", "it", "stopped"]]
    x, y = np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 4.0])
    knots, values = reading_level.isotonic(x, y)
    assert np.interp([1, 2, 3, 4], knots, values).tolist() == [1.0, 2.5, 2.5, 4.0]
    r = random.Random(6)
    lines = line_kinds.fit([sample_page(r, line_kinds.KINDS[k % 4]) for k in range(120)], [line_kinds.KINDS[k % 4] for k in range(120)])
    rows = [(1, " ".join(t for v, t in ANCHORS if v == 1) * 2, None), (2, None, None), (3, "", "en"), (4, " ".join(t for v, t in ANCHORS if v == 3), "en")]
    df = spark.createDataFrame(rows, "item_id long, text string, label string")
    got = {x["item_id"]: x for x in reading_level.levels(df, languages, lines, ranker).collect()}
    assert got[1]["level"] == 1 and got[2]["level"] is None and got[3]["n_sentences"] == 0 and got[4]["level"] == 3
    assert reading_level.levels(df.limit(0), languages, lines, ranker).count() == 0
    with pytest.raises(ValueError):
        reading_level.Ranker.fit([(1, "")])


def test_words_are_cut_at_blanks_only():
    codes, words, lengths = language_id.words_of(pa.array(["a\tb\nc", None, "x y"]))
    assert lengths.tolist() == [3, 1, 1] and [words[c] for c in codes] == ["a", "b", "c", "", "x y"]


def test_wrong_labels_of_long_texts_take_no_class():
    """A kind of English text of its own words, a few long ones of them labelled as a rare language, must stay English."""
    r = random.Random(9)
    rare = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(5)) for _ in range(40)]
    learned = lambda n: " ".join(r.choice(rare) if r.random() < 0.75 else r.choice(["the", "of", "and", "to", "this"]) for _ in range(n))
    sample = [(text(r, "en", 60), ["en"]) for _ in range(200)] + [("\n".join(learned(9) for _ in range(8)), ["en"]) for _ in range(60)]
    sample += [(text(r, "de", 40), ["de"]) for _ in range(4)] + [("\n".join(learned(9) for _ in range(200)), ["de"]) for _ in range(2)]
    model = language_id.fit(sample)
    prior = np.array([language_id.label_evidence(["en"])] * 20)
    (item, chosen, _, _, _), _ = language_id.classify(model, pa.array([learned(80) for _ in range(20)]), prior)
    assert sorted(item.tolist()) == list(range(20)) and {language_id.CLASSES[k] for k in chosen.tolist()} == {"en"}


def test_words_unseen_in_training(languages):
    """Unknown words between known ones don't change the language, and a word of any length is read whole."""
    r = random.Random(10)
    for lang in WORDS:
        words = text(r, lang, 60).split()
        for k in range(3, 60, 4):
            words[k] = "".join(r.choice("bdklmnrst") + r.choice("aeio") for _ in range(4))
        words[5] = "ab" * 50_000
        found = language_id.classify(languages, pa.array([" ".join(words)]), np.array([language_id.label_evidence([])]))[0]
        assert {language_id.CLASSES[k] for k, n in zip(found[1], found[3], strict=True) if n >= language_id.MIN_RUN} == {lang}


def test_unseen_hosts_and_the_shuffle_join_of_hosts(spark, languages, monkeypatch):
    r = random.Random(11)
    rows = [("x", k, text(r, "fr", 25), "fr" if k % 3 else None, "k", f"host{k % 7}") for k in range(60)] + [("x", 99, text(r, "de", 25), None, None, None)]
    df = spark.createDataFrame(rows, "src string, item_id long, text string, label string, kind string, host string")
    by_broadcast = sorted(map(str, language_id.identify(df, languages).collect()))
    monkeypatch.setattr(language_id, "MAX_HOSTS", 3)
    assert sorted(map(str, language_id.identify(df, languages).collect())) == by_broadcast and len(by_broadcast) == 61


def test_capitals_are_no_sentence_ends():
    caps = reading_level.sentences(["THE TEMPORARY DEPARTMENT HAS APPROVED THE ANNUAL REPORT.", "NOBODY SAW THE MIRROR."])
    assert [len(x) for x in caps] == [8, 4]
    assert [len(x) for x in reading_level.sentences(["The big cat ran to me The dog sat on our mat"])] == [6, 6]


def test_ranker_grows_on_texts_of_other_words():
    grown = [reading_level.sentences([t]) for t in ["The kid sat in my bus. The pig dug in the mud. A fox hid in a den."] * 3]
    assert reading_level.Ranker.fit(ANCHORS, grown).word_level.keys() > reading_level.Ranker.fit(ANCHORS).word_level.keys()


def test_sample_is_bounded(spark, monkeypatch):
    items = spark.range(3000).selectExpr("'a' as src", "id as item_id", "repeat('word ', 10) as text", "array('en') as declared")
    n = len(language_id.sampled(items, 500))
    assert 400 < n < 600 and len(language_id.sampled(items.limit(0), 500)) == 0
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 1000)
    assert len(language_id.sampled(items, 500)) == 20
