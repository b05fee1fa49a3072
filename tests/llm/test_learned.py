"""Operators that learn: label model, quality, toxicity, quality rules."""

import random

import numpy as np
import pytest

from tests.llm import fixtures as X
from tidegrid.llm import label_model, ngram_ratio, weak_quality, weak_toxicity

ODD = [(9001, None), (9002, ""), (9003, " \n"), (None, "some words without an id here and more of them to make ten"), (9004, "x"), (9004, "x")]


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.3
    flip = lambda p: np.where(rng.random(len(y)) < p, ~y, y).astype(int)
    a, b, c, d = flip(0.1), flip(0.2), flip(0.15), flip(0.25)
    copy = np.where(rng.random(len(y)) < 0.95, b, 1 - b)  # says what b says
    votes = np.stack([a, b, c, copy, d], 1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = label_model.LabelModel([2] * 5, find_copies=True).fit(patterns, counts.astype(float), np.stack([1 - patterns.mean(axis=1), patterns.mean(axis=1)], 1))
    assert model.copies == {(1, 3)}
    assert model.prior[1] == pytest.approx(0.3, abs=0.04)
    assert model.parents[3] == 1 or model.parents[1] == 3
    q = model.posterior(patterns)[:, 1][inverse.reshape(-1)]
    assert ((q > 0.5) == y).mean() > 0.9
    accuracy = model.accuracies()
    assert accuracy[0][1][1] == pytest.approx(0.9, abs=0.05)


def made(seed=0, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, toxic, bad = [], {}, {}
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic[i], bad[i] = int(rng.random() < 0.2), int(rng.random() < 0.2)
        if toxic[i]:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "Moron!", "worthless", "SCUM,"])
        if bad[i]:
            kind = rng.randrange(3)
            w = [x + "$$$" for x in w] if kind == 0 else [x for x in w[:20] for _ in range(8)] if kind == 1 else [y for x in w for y in (x, "|")]
        rows.append((i, " ".join(w)))
    return rows, toxic, bad


@pytest.fixture(scope="module")
def data(spark):
    rows, toxic, bad = made()
    labels = [(i, 1 - bad[i], toxic[i], "x") for i in toxic if i % 2] + [(None, 1, 1, "x"), (1, None, None, "x"), (9002, 1, 0, "x")]
    return X.frame(spark, rows + ODD).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").cache(), toxic, bad


def test_toxicity(data):
    docs, labels, toxic, _ = data
    got = weak_toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(toxic) + len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [i for i in toxic if by[i]["held_out"]]
    assert 0.1 < len(held) / len(toxic) < 0.3
    assert np.mean([by[i]["predicted"] == toxic[i] for i in toxic]) > 0.97
    assert by[9001]["predicted"] == by[9002]["predicted"] == 0


def test_toxicity_ignores_held_out_labels(spark, data):
    docs, labels, _, _ = data
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(weak_toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((str(r["doc_id"]), r["score"]) for r in weak_toxicity.toxicity(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_counts_every_annotation(spark, data):
    docs, labels, toxic, _ = data
    from pyspark.sql import functions as F

    texts = docs.select("doc_id", "text").where("text is not null")
    seen = weak_toxicity.counted(texts, labels)
    train = {r["doc_id"] for r in docs.select("doc_id", weak_toxicity.fold("doc_id").alias("f")).collect() if r["f"] != 0}
    got = {r["doc_id"]: r["said"] for r in seen.collect() if r["doc_id"] in toxic}
    assert got == {i: 1 + toxic[i] if i % 2 and i in train else 0 for i in toxic}
    # the sample is annotated as a whole as soon as there are enough annotated rows
    picked = weak_toxicity.wanted(seen, sum(x > 0 for x in got.values()), sum(x == 0 for x in got.values()), 100).collect()
    assert len(picked) > 50 and all(r["said"] > 0 for r in picked)
    # twenty times the rows with a twentieth of a sample each: the model says the same
    more = texts.crossJoin(spark.range(20)).select((F.col("doc_id") + 100_000 * F.col("id")).alias("doc_id"), "text")
    more_labels = labels.crossJoin(spark.range(20)).select((F.col("doc_id") + 100_000 * F.col("id")).alias("doc_id"), "toxic")
    scores = {r["doc_id"]: r["score"] for r in weak_toxicity.toxicity(more, more_labels, sample_rows=400).collect()}
    assert np.mean([(s >= 0.5) == toxic[i % 100_000] for i, s in scores.items() if i is not None and i % 100_000 in toxic]) > 0.97


def harmless_words(n):
    """Texts where 'worth' words fire, which are never toxic, and 'mind' words, which are always: only annotations tell."""
    texts = ["please take the garbage to the parasite ward of the old town hall", "listen to me now idiot of the old town hall", "a plain line of the old town hall"]
    return [(i, texts[0 if i % 10 < 3 else 1 if i % 10 < 5 else 2]) for i in range(n)], [(i, int(i % 10 in (3, 4))) for i in range(n) if i // 10 % 5 < 2]


@pytest.mark.parametrize("n", [1000, 20_000])
def test_toxicity_anchor_does_not_fade(spark, n):
    rows, labels = harmless_words(n)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in weak_toxicity.toxicity(docs, marks, sample_rows=400).collect()}
    assert np.mean([got[i] == (i % 10 in (3, 4)) for i in got]) > 0.99


def test_toxicity_learns_abuse_that_no_lexicon_names(spark):
    """Half of the texts are in a language whose abusive words no voter knows: stems with changing endings, most seen once."""
    rng = random.Random(3)
    ends = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    plain = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for letters in ("aeioulnrst", "bdgkoöuüaä")]
    rows, toxic = [], {}
    for i in range(4000):
        lang = i % 2
        w = [rng.choice(plain[lang]) for _ in range(rng.randint(20, 80))]
        toxic[i] = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 4) * toxic[i]):
            w[rng.randrange(len(w))] = rng.choice(["zworg", "krälb"]) + rng.choice(ends) if lang else rng.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in toxic.items() if i % 5 < 3], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in weak_toxicity.toxicity(docs, labels).collect()}
    for lang in (0, 1):
        held = [i for i in got if got[i]["held_out"] and i % 2 == lang]
        assert np.mean([got[i]["predicted"] for i in held if toxic[i]]) >= 0.9
        assert np.mean([got[i]["predicted"] for i in held if not toxic[i]]) <= 0.02


def test_annotators_errors_are_estimated():
    bits, said = np.array([0, 0, 0, 1, 1, 1]), np.array([0, 1, 2, 0, 1, 2])
    model = weak_toxicity.label_model(bits, said, np.array([6000.0, 3900.0, 100.0, 600.0, 4.0, 396.0]))
    table = model.tables[-1][:, 0, :]
    assert table[0, 2] < 0.01 and (table[1:, 1] < 0.05).all()
    ask = lambda b, s: 1 - model.posterior(np.array([[*weak_toxicity._unpacked(np.array([b]))[0], s]]))[0, 0]
    assert ask(0, 2) > 0.8 and ask(0, 1) < 0.01 and ask(1, 0) > 0.9 and ask(0, 0) < 0.1


def test_toxicity_of_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(1, f"a line {k} for an idiot") for k in range(300)] + [(i, "a plain line of text") for i in range(2, 60)], "doc_id long, text string")
    got = weak_toxicity.toxicity(docs, spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 60)], "doc_id long, toxic int"), sample_rows=100).collect()
    assert len(got) == 358


def test_toxicity_without_rows_or_labels(spark, data):
    docs, labels, toxic, _ = data
    assert weak_toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in weak_toxicity.toxicity(docs, labels.limit(0)).collect() if r["doc_id"] in toxic]) > 0.9
    kept = weak_toxicity.accepted(docs, weak_toxicity.fit(docs, None))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality(data):
    docs, _, _, bad = data
    got = weak_quality.quality(docs).collect()
    assert len(got) == len(bad) + len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert np.mean([by[i]["kept"] != bool(bad[i]) for i in bad]) > 0.97
    assert not by[9001]["kept"] and by[9001]["n_words"] == 0
    assert weak_quality.quality(docs.limit(0)).count() == 0


def test_quality_rules_against_brute_force(spark, data):
    docs, labels, _, bad = data
    trusted = labels.where("quality = 1").select("doc_id")
    for rows, frame in ((X.corpus(), X.frame(spark, X.corpus())), (made()[0] + ODD, docs)):
        got: dict = {}
        for r in ngram_ratio.quality(frame, trusted).collect():
            got.setdefault(r["doc_id"], []).append(r)
        for i, t in rows:
            t = t or ""
            w = X.SPACE_WORD.findall(t)
            lines = [x for x in t.split("\n") if X.SPACE_WORD.search(x)]
            at: dict = {}
            for p in range(len(w) - 4):
                at.setdefault(tuple(w[p : p + 5]), []).append(p)
            covered = {q for ps in at.values() if len(ps) > 1 for p in ps for q in range(p, p + 5)}
            want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))
            for r in got[i]:
                assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
                assert not (r["kept"] and r["base_failed"])
        assert sum(map(len, got.values())) == len(rows)
    by = {k: v[0] for k, v in got.items()}
    assert np.mean([by[i]["kept"] != bool(bad[i]) for i in bad]) > 0.95
    assert ngram_ratio.quality(docs.limit(0), trusted).count() == 0


def test_quality_rules_stay_in_the_plan(data):
    docs, labels, _, _ = data
    plan = ngram_ratio.quality(docs, labels.where("quality = 1").select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
