"""Words, near words, forms and roots against their definitions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from odlake.llm import queries as registered
from odlake.llm import spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def expected(rows, near_by=None):
    total = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                total[run] += 1
    n = {w: c for w, c in total.items() if c >= 5}
    out, form = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = len(near)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n int, root string")


def noisy(seed, letters="abcdé", texts=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(25)]
    rows = []
    for k in range(texts):
        words = [rng.choice(base[: rng.randint(1, 25)]) for _ in range(rng.randint(0, 200))]
        for i in range(len(words)):
            if rng.random() < 0.15:
                w, p = words[i], rng.randrange(len(words[i]))
                words[i] = rng.choice([w[:p] + w[p + 1 :], w[:p] + "a" + w[p:], w[:p] + "b" + w[p + 1 :], w.upper(), w.title()])
        rows.append((k, rng.choice([" ", "-", "1", ". ", "ß", "Ω"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_variants_by_brute_force(spark, seed):
    rows = noisy(seed, "abcdé" if seed % 2 else "aiqy")
    got = sorted(map(tuple, spelling.variants(docs(spark, rows).repartition(5)).collect()), key=lambda r: r[0])
    assert got == expected(rows) and any(r[1] for r in got) and any(r[2] != r[0] for r in got)


def test_hard_cases(spark):
    assert spelling.variants(docs(spark, [])).collect() == []
    assert spelling.variants(docs(spark, [(1, None), (2, ""), (None, "short words only " * 9)])).collect() == []
    same = [(7, "ÀÉÎÕÜý× ÀÉÎÕÜý÷ àéîõüý " * 6)] * 3 + [(None, "Letters letterss " * 30), (None, "lettersss " * 5), (4, "letters " * 700)]
    got = sorted(map(tuple, spelling.variants(docs(spark, same)).collect()))
    assert got == expected(same) and {r[0] for r in got} >= {"ÀÉÎÕÜý×", "àéîõüý", "letters", "letterss"}
    assert {r[0]: r[2] for r in got}["lettersss"] == "letters"


def test_long_texts_and_long_runs(spark, monkeypatch):
    rows = noisy(9)
    text = " ".join(t for _, t in rows)
    whole = spelling.counted(3, text, 6, 199)
    monkeypatch.setattr(spelling, "PIECE", 50)
    assert spelling.counted(3, text, 6, 199) == whole
    long = "abcdefgh" * 2500
    rows = [(1, f"{long} {long}x " * 5)]
    got = {r["word"]: r["n_near"] for r in spelling.variants(docs(spark, rows)).collect()}
    assert got == {long: 1, long + "x": 1}


def test_neighbourhoods_are_whole():
    """The keys are those of all strings that one edit makes of the reduced word, each once."""
    for word in ("aaaaaa", "abcdefg", "zyxàéabc"):
        s = [ord(c) % 8 for c in word]
        made = {tuple(s)} | {tuple(s[:k] + s[k + 1 :]) for k in range(len(s))}
        made |= {tuple(s[:k] + [q] + s[k + 1 :]) for k in range(len(s)) for q in range(8)} | {tuple(s[:k] + [q] + s[k:]) for k in range(len(s) + 1) for q in range(8)}
        keys = {int(spelling.Reduced(["".join(chr(96 + q) for q in t)], 8).own()[0]) for t in made}
        row, near = spelling.Reduced([word], 8).near()
        assert set(near.tolist()) == keys and len(near) == len(made) and not row.any()
        assert near.dtype == np.int64


def test_the_query_on_the_given_table(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registered.op11_spelling(spark, SF).collect())) == expected(given)
