"""Leaks with altered or coinciding values, and items of few plain words."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from odlake.llm import templates

LONG = "the old farmer has 7 red apples and his younger daughter brings some more of them from the garden while the neighbours sell 7 green pears near the river and nobody knows how many fruits they all have in the end"
TWO = "If the boy buys 3 apples at the market and then the girl buys 4 apples at the shop how many apples do the two of them have in total"
DENSE = "12 kg 15 cm 30 ml and 7 hours 22 km plus 14 mm with 9 oz or 81 lbs"


def test_leaks(spark):
    items = spark.createDataFrame([(1, LONG), (2, TWO), (3, DENSE), (4, "5 7 of 9 11"), (5, "1 2 3")], "item_id long, text string")
    rows = [
        (1, "Look: " + LONG.replace("7 green", "8 green") + " ."),
        (2, TWO.replace("3 apples", "5 apples").replace("4 apples", "5 apples")),
        (3, TWO.replace("3 apples", "4 apples")),
        (4, "before " + DENSE + " after"),
        (5, "before " + DENSE.replace("22 km", "23 km") + " after"),
        (6, "so 5 7 of 9 11 it is"),
        (7, "so 5 7 of 9 12 it is 1 2 3"),
        (8, "nothing of it here " * 20),
    ]
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in templates.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1): True, (2, 2): True, (3, 2): True, (4, 3): False, (6, 4): False}


NAMES = "If Anna Maria Smith buys 3 apples at the market and then Bob brings 4 apples to the house of Anna Maria Smith how many apples do the two hold"


def test_names_of_several_words_and_number_words(spark):
    items = spark.createDataFrame([(1, NAMES)], "item_id long, text string")
    rows = [
        (1, NAMES.replace("Anna Maria Smith", "Jo")),
        (2, NAMES.replace("Anna Maria Smith", "Carl Heinz").replace("3", "seven").replace("4", "twelve")),
        (3, NAMES.replace("3", "5").replace("4", "5").replace("the two", "the five")),
        (4, NAMES.lower().replace("apples", "cars").replace("market", "sea").replace("brings", "sells").replace("house", "end")),
    ]
    assert {r["doc_id"] for r in templates.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()} == {1, 2, 3}


def canonical(text, names):
    """(word or kind, value) of each canonical word, by the definition."""
    made, fresh, number = [], True, False
    for w in re.findall(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*|[.!?\n]", text):
        if w in ".!?\n":
            fresh = True
            continue
        low = w.lower()
        if w[0].isdigit() or low in templates.NUMBERS:
            kind = "number"
        elif low in templates.UNITS:
            kind = "unit" if number else low
        elif names == 1 and w[0].isupper() and not fresh:
            kind = "name"
        else:
            kind = low
        number = kind == "number"
        if names == 2:
            kind = low
        if kind == "name" and made and made[-1][0] == "name":
            made[-1] = ("name", made[-1][1] + " " + low)
        else:
            made.append((kind, low))
        fresh = False
    return made


def windows(words, size):
    """Where windows with enough plain words begin."""
    return [k for k in range(len(words) - size + 1) if sum(kind == value for kind, value in words[k : k + size]) >= 4]


def leaked(doc, item):
    """By the definition, from all pairs of windows."""
    if len(canonical(item, 2)) < 4:
        return False
    tried = False
    for names in (0, 1, 2):
        theirs, ours = canonical(item, names), canonical(doc, names)
        size = min(8, len(theirs))
        at = windows(theirs, size)
        need = len(at) if names == 2 else min(-(-(len(theirs) - size + 1) // 2), 6, max(-(-len(at) // 2), 3))
        if len(at) < need or names == 2 and (tried or not at):
            continue
        tried = True
        hits = {}
        for a in at:
            for b in windows(ours, size):
                if [k for k, _ in theirs[a : a + size]] == [k for k, _ in ours[b : b + size]]:
                    hits.setdefault(b - a, []).append((a, b))
        for pairs in hits.values():
            slots = {(a, b): [(f"{k}:{v}", f"{k}:{w}") for (k, v), (_, w) in zip(theirs[a : a + size], ours[b : b + size]) if k != v or k != w] for a, b in pairs}
            votes = Counter(s for some in slots.values() for s in some)
            best = {}
            for (i, d), n in votes.items():
                best[i] = max(best.get(i, (0, False, "")), (n, i == d, d))
            if sum(all(best[i][2] == d for i, d in some) for some in slots.values()) >= need:
                return True
    return False


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = "the old boy buys some red apples and then sells them at market near river for money while sister counts days of trip".split()
    def sentence(n):
        return " ".join(rng.choice([rng.choice(pool)] * 7 + [str(rng.randint(1, 9)), rng.choice(["two", "seven"]), rng.choice(["Anna", "Bob", "Carl Max"]), rng.choice(["km", "hours"]), "."]) for _ in range(n))
    items = [(k, sentence(rng.choice([3, 5, 9, 15, 25, 40]))) for k in range(40)]
    rows = []
    for k in range(160):
        words = rng.choice(items)[1].split(" ")
        for _ in range(rng.choice([0, 1, 2, 4])):
            at = rng.randrange(len(words))
            words[at] = rng.choice(["3", "8", "Bob", "Dora Lee", "eleven", "kg", rng.choice(pool)])
        rows.append((k, f"{sentence(rng.randint(0, 12))} {' '.join(words)} {sentence(rng.randint(0, 12))}"))
    rows += [(900, None), (901, ""), (902, rows[0][1] + " " + sentence(30_000))]
    got = {(r["doc_id"], r["item_id"]) for r in templates.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    small = [r for r in rows if r[0] != 902]
    expected = {(d, i) for d, t in small for i, x in items if leaked(t or "", x)}
    assert {p for p in got if p[0] != 902} == expected and expected
    assert {(902, i) for d, i in expected if d == 0} <= got
