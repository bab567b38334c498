"""The bounded training sample: neither large texts nor labels of other documents may empty it."""

from __future__ import annotations

import numpy as np
import pytest

from odlake.llm import queries as registered
from odlake.llm import toxicity


def tables(spark, more=()):
    rows = [(k, ("you stupid moron " if k % 2 else "a kind word ") + f"w{'abcdefghij'[k % 10]}" * 3) for k in range(200)]
    docs = spark.createDataFrame([*rows, *more], "doc_id long, text string")
    return docs, [(k, 0, k % 2) for k, _ in rows]


def scores(docs, model):
    return {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, model).collect()}


def test_large_texts_do_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 12_000)
    docs, labels = tables(spark, [(k, "long words " * 900) for k in range(1000, 1040)])
    labels = spark.createDataFrame([*labels, *((k, 0, 0) for k in range(1000, 1040))], "doc_id long, quality int, toxic int")
    got = scores(docs, toxicity.trained(docs, labels))
    assert all(got[k] == k % 2 for k in range(200))


def test_labels_of_other_documents_do_not_use_it_up(spark):
    docs, labels = tables(spark)
    other = [(k, 0, k % 2) for k in range(10_000, 12_000)]
    labels = spark.createDataFrame([*labels, *other], "doc_id long, quality int, toxic int")
    got = scores(docs, toxicity.trained(docs, labels, positive=10, negative=20))
    assert all(got[k] == k % 2 for k in range(200))


def test_a_class_of_too_large_texts_fails(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 15)
    docs, labels = tables(spark)
    with pytest.raises(ValueError, match="both classes"):
        toxicity.trained(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


INSULTS = {"trash": "trassh", "pathetic": "pathettic", "worthless": "wortthless", "idiot": "idiiot", "disgusting": "disgustting", "loser": "loserr", "scum": "scumm", "clown": "clownn", "moron": "moronn", "stupid": "stuupid"}


def test_held_out_rows(spark):
    """What the registered query makes of rows whose labels it did not see: few false alarms, most toxic texts found."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")
    rows = registered.op2_toxicity(spark, sf).where("held_out").join(labels, "doc_id").where("toxic is not null").collect()
    s, y, p = (np.array([r[c] for r in rows]) for c in ("score", "toxic", "predicted"))
    above = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    assert p[y == 0].mean() <= 0.01 and p[y == 1].mean() >= 0.6 and above >= 0.88


def test_unseen_misspellings(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.trained(docs, labels)
    worth = toxicity.Words(model)
    around = "the and of to in that " * 2
    clean = model.score(worth, around + "then")
    assert all(model.score(worth, around + wrong) > clean for wrong in INSULTS.values())
    assert all(model.score(worth, around + right) > clean for right in INSULTS)


def test_a_run_of_one_word_counts_once_and_windows_begin_anywhere():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), -1.0)
    model.margin[toxicity.grams("bad")] = 1.0
    worth = toxicity.Words(model)
    fill = [f"{a}{b}" for a in "cdefg" for b in "xyzuvw"]
    assert model.score(worth, "bad " * 50) == model.score(worth, "bad")
    scores = {round(model.score(worth, " ".join([*fill[:k], "bad", "q", "bad", *fill[k:]])), 12) for k in range(len(fill))}
    assert len(scores) == 1


def test_very_long_and_empty_texts():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.0)
    worth = toxicity.Words(model)
    words = ["".join(rng.choice(list("abcd"), 5)) for _ in range(400)]
    text = " ".join(rng.choice(words, 300_000))
    assert 0 <= model.score(worth, text) <= 1 and model.score(worth, "") == model.score(worth, "1 2 !") == 0.5
    each = np.array([worth[w] for w in words])
    best, begin = toxicity.tops(each, np.array([3, 3 + 200, 400]))
    parts = [each[:3], each[3:203], each[203:]]
    assert np.allclose(best, [max(np.mean(p[k : k + 16]) for k in range(max(1, len(p) - 15))) for p in parts])
    assert all(np.isclose(each[b : b + min(16, len(p))].mean(), m) for b, m, p in zip(begin, best, parts))
