"""Filter interactions against plain Python, bit counts, and edge cases."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest

from stridelake.llm import interaction as I

DOCS = "doc_id long, text string, source string, part string, good int"


def words(n: int, prefix: str = "w", every: int = 1) -> str:
    return " ".join(f"{prefix}{i // every}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    long, loud = words(60), words(60).upper()
    out = [(1, long, "a"), (2, long, "b"), (3, long, None), (3, long, None), (4, loud, "a"), (5, words(55, every=3), "a"), (6, None, "a"), (7, "", ""), (8, "", "a"), (9, long + " 5%", "a")]
    out += [(None, long, "a"), (None, "alone", "c"), (10, " \x1f\x0b ", "c"), (11, words(40000), "c"), (1, long, "a")]
    return out + [(20 + i, words(45 + i, every=1 + i % 3) + (" #" if i % 4 == 0 else "") + (" ABCDEFGHIJKLMNOP" if i % 5 == 0 else ""), "abc"[i % 3]) for i in range(40)]


def expected(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    told = []
    for d, text, source in rows:
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        e = d is not None and any(o is not None and o < d and (t or "") == text for o, t, _ in rows)
        fails = {"A": len(found) < 50, "B": 100 * len(set(found)) < 65 * len(found), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": e}
        told.append((source or "", d in good, d in toxic, fails))
    out = {}
    for part in {p for p, *_ in told}:
        own = [(g, t, f) for p, g, t, f in told if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                stay, gone = [r for r in left if not r[2][x]], [r for r in left if r[2][x]]
                failing = [r for r in own if r[2][x]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), len(failing) - len(gone), sum(sum(r[2].values()) == 1 for r in failing), sum(r[0] for r in gone), sum(r[1] for r in gone)]
                left = stay
        for (p, order, step), got in out.items():
            if p == part:
                got.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_interactions_equal_brute_force(spark, rows):
    labels = [(i, i % 2, i % 7 == 0) for i in range(30)] + [(1, 0, True), (2, None, None), (None, 1, True)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], DOCS).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in I.interactions(docs, marks).collect()}
    assert got == expected(rows, labels)
    assert I.interactions(docs.limit(0), marks).count() == 0
    assert I.interactions(docs, marks.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def test_positional_popcount():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 8, 100, 1001):
        w = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert I.positional_popcount(w).tolist() == [int(((w >> np.uint32(b)) & np.uint32(1)).sum()) for b in range(32)]


def test_word_of_subsets():
    for fails in range(32):
        word = int(I.survival_word(np.array([fails]))[0])
        assert all(bool(word >> s & 1) == (s & fails == 0) for s in range(32))


def test_many_parts_are_given_away(spark, monkeypatch):
    monkeypatch.setattr(I, "HELD_GROUPS", 3)
    docs = spark.createDataFrame([(i, words(50 + i % 9), f"p{i % 40}") for i in range(200)], "doc_id long, text string, source string")
    out = I.interactions(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.filter("filter_order = 'ABCDE' AND step = 1").agg({"kept": "sum"}).first()[0] == 200
