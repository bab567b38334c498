"""Winnowing against its definition, gram by gram and window by window, and the order of neighbours against a sort."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from odlake.llm import queries as registered
from odlake.llm import winnowing
from odlake.llm.winnowing import Winnower, likeness

SF = "/root/testdata/sf0.001"


def plainly(w: Winnower, text: str):
    """The definition: each gram hashed by itself, each window looked through."""
    points = np.array([ord(c) for c in text], np.uint64)
    grams = [w.hashes(points[i : i + w.gram])[0] for i in range(max(1, len(text) - w.gram + 1))] if text else []
    n = min(w.window, len(grams))
    chosen = sorted({max((i for i in range(at, at + n)), key=lambda i: (-int(grams[i]), i)) for at in range(len(grams) - n + 1)}) if grams else []
    return [int(grams[i]) for i in chosen], chosen


@pytest.mark.parametrize("gram, window", [(5, 4), (20, 50), (1, 1), (3, 1)])
def test_chosen_by_definition(gram, window):
    rng, w = random.Random(gram), Winnower(gram, window)
    for text in ["", "a", "ab" * 40, "a" * 300, "é😀\0" * 30, *("".join(rng.choice("abc ") for _ in range(rng.randint(0, 400))) for _ in range(40))]:
        hashes, places = w.chosen(text)
        assert (hashes.tolist(), places.tolist()) == plainly(w, text)


def test_blocks_of_a_long_text_join(monkeypatch):
    rng, w = random.Random(3), Winnower(6, 9)
    text = "".join(rng.choice("abcd") for _ in range(3000)) + "z" * 500
    whole = [x.tolist() for x in w.chosen(text)]
    monkeypatch.setattr(winnowing, "BLOCK", 97)
    assert [x.tolist() for x in w.chosen(text)] == whole


def test_a_shared_passage_is_always_found():
    rng, w = random.Random(5), Winnower()
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(200):
        shared = words(winnowing.GRAM + winnowing.WINDOW - 1)
        a, b = words(rng.randint(0, 300)), words(rng.randint(0, 300))
        (ha, pa), (hb, pb) = w.chosen(a + shared + words(100)), w.chosen(b + shared + words(50))
        both = {(h, p - len(a)) for h, p in zip(ha.tolist(), pa.tolist())} & {(h, p - len(b)) for h, p in zip(hb.tolist(), pb.tolist())}
        assert any(0 <= p <= winnowing.WINDOW - 1 for _, p in both)


def expected(rows):
    """Neighbours by one sort: id falling, nulls last, then the hash of the text as Spark gave it."""
    w, out = Winnower(), []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    for k, (name, text, _) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, other = w.chosen(text), w.chosen(edited), w.chosen(after)
        out.append((name, len(text), hashlib.sha256(edited.encode()).hexdigest(), winnowing.as_text(*own), winnowing.as_text(*changed), likeness(own[0], changed[0]), likeness(own[0], other[0])))
    return sorted(out, key=repr)


def check(spark, docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    got = sorted(map(tuple, winnowing.beside_next(docs).collect()), key=repr)
    assert got == expected([tuple(r) for r in rows])


HARD = [(5, "long " * 400), (4, None), (3, ""), (9, "é😀 word " * 60), (9, "another text of one id " * 9), (9, "another text of one id " * 9), (None, "no id at all " * 20), (None, None), (7, "short"), (-2, "the last of all " * 30)]


@pytest.mark.parametrize("rows", [[], HARD[:1], HARD[1:2] * 2, HARD, HARD * 3])
def test_neighbours_on_hard_cases(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, id string, range int, border string")
    check(spark, docs)
    check(spark, docs.repartition(7))


def test_neighbours_on_the_given_table(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet").repartition(5))
    rows = registered.op12_winnowing(spark, SF).collect()
    assert len(rows) == 200 and all(0 <= r["near_next"] <= 1 for r in rows)
    long = [r for r in rows if r["n_chars"] > 2000]
    assert min(r["near_edited"] for r in long) > 0.15 and sum(r["near_edited"] for r in long) / len(long) > 0.28


def test_equal_texts_have_equal_fingerprints_wherever_they_are(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["same " * 50, "other words " * 30, "same " * 50, None, ""])], "doc_id long, text string")
    made = {r["doc_id"]: (r["hashes"], r["places"]) for r in winnowing.fingerprints(docs).collect()}
    assert made[0] == made[2] != made[1] and made[3] == made[4] == ([], [])
    rows = {r["doc_id"]: r for r in winnowing.beside_next(docs).collect()}
    assert rows[0]["fingerprint"] == rows[2]["fingerprint"] and rows[4]["near_next"] == 1.0 and rows[3]["near_edited"] == 1.0
