"""The source divergence audit against plain Python, its perfect hashes, and edge cases."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stridelake.llm import divergence as D

DOCS = "doc_id long, text string, lang string, source string, slot int, term string"


def expected(rows, least=3):
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for _, text, lang, source in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    kept = {lang: [t for t, c in counts.items() if c >= least] for lang, counts in df.items()}
    p = lambda count, total, v: 1 + 10**9 * (count + 1) // (total + v)
    out = set()
    for lang in {x for x, *_ in docs}:
        terms, sources = kept.get(lang, []), sorted({s for x, s, _ in docs if x == lang})
        v, total = len(terms), {s: sum(n[lang, s][t] for t in terms) for s in sources}
        of = {s: {t: p(n[lang, s][t], total[s], v) for t in terms} for s in sources}
        all_ = {t: p(sum(n[lang, s][t] for s in sources), sum(total.values()), v) for t in terms}
        for s in sources:
            pairs = [(-sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in terms), o) for o in sources if o != s]
            own = [(-((of[s][t] - all_[t]) ** 2 // all_[t]), t) for t in terms if n[lang, s][t] and of[s][t] > all_[t]]
            for part, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= 200}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in ("to", "Ré", "ÄÖ", "za", "x", "日本", "q\u0085") for b in "abcdefghijklmnopqrstuvwxyz"]
    some = lambda k, s: " ,1_".join(vocabulary[i] for i in (rng.zipf(1.4, k) * (s + 1)) % len(vocabulary))
    out = [(i, some(int(rng.integers(0, 60)), i % 3), ["en", "de"][i % 2], f"s{i % 3}") for i in range(60)]
    out += [(100, None, "en", "s0"), (101, "", None, None), (102, "alone", "en", "empty"), (103, "Word", "x", "a"), (104, "word", "x", "b"), (105, "WORD word", "x", "b"), (106, "1 2 3", "y", "one")]
    return out + [(107, "word " * 200000, "x", "c"), (108, "tie Tie", "x", "c"), (1, "tie", "x", "c"), (1, "tie", "x", "c")]


@pytest.mark.parametrize(("shard_keys", "block_bytes", "slots", "held"), [(1 << 16, 1 << 26, 1 << 25, 1 << 18), (10, 300, 40, 5)])
def test_divergences_equal_brute_force(spark, rows, monkeypatch, shard_keys, block_bytes, slots, held):
    """Once with everything in one block, once with many shards, blocks and flushes."""
    monkeypatch.setattr(D, "HELD_SLOTS", slots)
    monkeypatch.setattr(D, "HELD_TERMS", held)
    monkeypatch.setattr(D, "BROADCAST_GROUPS", 100_000 if held > 5 else 0)
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], DOCS).repartition(3)
    got = [tuple(r) for r in D.divergences(docs, shard_keys=shard_keys, block_bytes=block_bytes).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows)


def test_empty_tables(spark):
    assert D.divergences(spark.createDataFrame([], DOCS)).count() == 0
    rare = spark.createDataFrame([(1, "a b", "en", "s", 0, ""), (2, "c", "en", "t", 0, "")], DOCS)
    assert sorted(tuple(r) for r in D.divergences(rare).collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70000])
def test_perfect_hash_is_minimal_and_verified(n):
    terms = [b"t%d" % i for i in range(n)]
    shard = D.Shard.of(terms)
    hashes = D._hashes(terms)
    slots = shard.slots(pa.array(terms, pa.binary()), hashes)
    assert sorted(slots.tolist()) == list(range(n)) and [shard.terms[int(s)].as_py() for s in slots[:50]] == terms[:50]
    foreign = [b"f%d" % i for i in range(500)]
    assert (shard.slots(pa.array(foreign, pa.binary()), D._hashes(foreign)) == -1).all()


def test_terms_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(D, "_hashes", lambda terms: np.array([len(t) for t in terms], dtype=np.uint64))
    terms = [b"a", b"b", b"cc", b"dd", b"eee"]
    shard = D.Shard.of(terms)
    asked = [*terms, b"z", b"yy", b"ffff"]
    got = shard.slots(pa.array(asked, pa.binary()), D._hashes(asked)).tolist()
    assert sorted(got[:5]) == [0, 1, 2, 3, 4] and got[5:] == [-1, -1, -1]


def test_hash_equals_sparks(spark):
    terms = ["a", "été", "日本", "x" * 100]
    told = spark.createDataFrame([(t,) for t in terms], "t string").selectExpr("xxhash64(cast(t as binary)) AS h").collect()
    assert [r.h % (1 << 64) for r in told] == D._hashes([t.encode() for t in terms]).tolist()


def test_share_is_exact():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 9 * 10**15, 2000)
    counts = (total * rng.random(2000)).astype(np.int64) - 1
    counts = np.clip(counts, 0, None)
    assert D.share(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, total, strict=True)]
