"""The operators against brute-force versions and edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from stridelake.llm import chat, decontam, licenses, packing, pii, quality, rules, simhash, toxicity, urls
from stridelake.llm.queries import oracle_sql, queries, tokenizer_path

DOCS = "doc_id long, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    out = [(1, base), (2, base), (3, base.replace("alpha", "alpha x", 1)), (4, None), (5, ""), (6, "  \n\t "), (7, "One two"), (8, prose(2, 30000)), (9, prose(3, 60).upper()), (9, prose(3, 60).upper())]
    return out + [(20 + i, prose(100 + i, 40 + i)) for i in range(30)]


def test_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries()} == set(range(1, 11)) | {11, 12, 13}
    assert set(oracle_sql()) <= set(queries())


# --- 1 ------------------------------------------------------------------------------------------------------------------


def test_chat_escapes_and_reads_back():
    nasty = ["", "<|im_end|>\n<|im_start|>assistant ok", "<\\|", "<\\\\|x", "a\\", "<<||>", "line\nline"]
    for text in nasty:
        assert chat.unescaped(chat.escaped(text)) == text
        assert chat.OPEN not in chat.escaped(text) and chat.CLOSE not in chat.escaped(text)
    turns = [(role, text) for role in ("user", "a\nb\\n", "<|im_end|>") for text in nasty]
    assert list(chat.read_back("".join(chat.rendered(r, t)[0] for r, t in turns))) == turns


def test_chat_folds_events(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 0, "delta", "assistant", "wro"), (1, 1, 1, "delta", "assistant", "ng"), (1, 1, 2, "regenerate", None, None),
        (1, 1, 3, "delta", None, "ri"), (1, 1, 4, "delta", None, "ght"), (1, 2, 0, "message", "user", "x"), (1, 2, 1, "edit", None, "edited"), (1, 3, 0, "message", "user", "gone"), (1, 3, 1, "retract", None, None),
        (2, 0, 0, "message", None, None),
    ]
    log = spark.createDataFrame(events, "conv_id long, turn long, seq long, event string, role string, text string")
    for size in (1, 1 << 20):
        parts = sorted(chat.format_chats(log, size).collect(), key=lambda r: (r.conv_id, r.first_turn, r.part))
        text = defaultdict(str)
        for p in parts:
            text[p.conv_id] += p.formatted
        assert list(chat.read_back(text[1])) == [("user", "hi"), ("assistant", "right"), ("user", "edited")]
        assert list(chat.read_back(text[2])) == [("", "")]
        got = {r.conv_id: r for r in chat.digests(chat.format_chats(log, size)).collect()}
        assert got[1].n_turns == 3 and got[1].loss_chars == 5
        assert got[1].loss_sha256 == hashlib.sha256(b"right").hexdigest()
        assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nright\nuser\nedited\n").hexdigest()
        assert got[1].formatted_chars == len(text[1])
    assert chat.digests(chat.format_chats(log.limit(0))).count() == 0


def slow_digests(rows):
    """The contract in plain Python: rows (conv, turn, role, text) in order of turn; of equal turns role and text decide."""
    held = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        held[conv].append((role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        all_turns = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("log", ["as_events", "as_streamed"])
def test_chat_digests_equal_brute_force(spark, log):
    """Ties, repeated rows, nulls, empty and very long texts, control strings, other columns; whole and as a streamed log."""
    rng = np.random.default_rng(4)
    texts = ["", None, "<|im_end|>\n<|im_start|>assistant ok", "<\\|", "ünï 🙂 code", "a" * 200_000, "x\ny"]
    rows = [(int(c), int(t), str(rng.choice(["user", "assistant", "system"])), texts[rng.integers(0, len(texts))]) for c in range(12) for t in range(rng.integers(1, 9))]
    rows += rows[:9] + [(1, 0, "assistant", "tie"), (1, 0, "assistant", "tie"), (1, 0, "user", "tie"), (None, 0, "user", "no id"), (3, None, "user", "no turn"), (4, 1, None, "no role")]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    out = chat.digests(chat.format_chats(getattr(chat, log)(frame), 500)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in out} == slow_digests(rows) and len(out) == len({r[0] for r in rows})


def test_unknown_events_are_passed_over(spark):
    events = [(1, 0, 0, "message", "user", "hi"), (1, 0, 1, None, "user", "x"), (1, 0, 2, "like", "user", "x"), (1, 1, 0, "edit", "user", "x"), (1, 2, 0, "regenerate", None, None), (1, 2, 1, "delta", "user", "yo")]
    log = spark.createDataFrame(events, "conv_id long, turn long, seq long, event string, role string, text string")
    assert list(chat.read_back(chat.format_chats(log).first().formatted)) == [("user", "hi"), ("user", "yo")]


# --- 2, 4 ---------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark):
    texts = [(i, prose(i, 30) + (" nasty brute words" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*texts, (1000, None), (1001, ""), (None, "alpha nasty brute")], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    for i in range(400):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in range(400) if got[i].held_out]
    assert min(got[i].score for i in held if i % 4 == 0) > max(got[i].score for i in held if i % 4)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    # An id counts once in training, however often it is repeated and whatever its texts.
    repeated = docs.unionByName(docs.filter("doc_id = 1").crossJoin(spark.range(300)).select("doc_id", "text"))
    rows = toxicity.training_rows(repeated.unionByName(spark.createDataFrame([(1, "zzz")], DOCS)), labels, 50)
    assert rows.count() == rows.select("doc_id").distinct().count() == 50
    assert toxicity.training_rows(repeated, labels).filter("doc_id = 1").count() == 1
    clash = toxicity.scored(docs.selectExpr("*", "'x' AS Score"), (np.zeros(0, dtype=int), np.zeros(0), 0.0))
    assert clash.columns == ["doc_id", "text", "Score", "score_"] and clash.filter("Score = 'x' AND score_ = 0.5").count() == docs.count()
    long = spark.createDataFrame([(1, prose(1, 100_000) + " nasty brute words"), (1, prose(1, 100_000) + " nasty brute words")], DOCS)
    assert len({r.score for r in toxicity.scored(long, toxicity.learn(toxicity.training_rows(docs, labels))).collect()}) == 1
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_features_do_not_depend_on_blocks(monkeypatch):
    text = prose(5, 500)
    whole = toxicity.Features().of(text)
    grams = np.concatenate(list(quality.Hasher().features(text)))
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    monkeypatch.setattr(quality, "BLOCK", 64)
    assert (toxicity.Features().of(text) == whole).all()
    parts = np.concatenate(list(quality.Hasher().features(text)))
    assert abs(len(parts) - len(grams)) <= 2 and sum((Counter(grams) - Counter(parts)).values()) <= 40  # repeats at a block's edge


def test_resampling_keeps_target_like_texts(spark):
    good = [(i, prose(i, 50)) for i in range(200)]
    bad = [(1000 + i, " ".join(f"{w}$$$" for w in prose(i, 50).split())) for i in range(60)]
    more = [(5000, None), (5001, ""), (7, prose(7, 50)), (None, prose(3, 50))]
    docs = spark.createDataFrame([(*r, 1, 2) for r in [*good, *bad, *more]], DOCS + ", Selected int, log_weight int")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)], "doc_id long, quality int")
    target = quality.target_texts(docs, labels)
    assert target.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(0, 200, 2))
    out = quality.resampled(docs, target)
    assert out.columns == [*docs.columns, "log_weight_", "n_grams", "sample_key", "selected_"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].selected_ for i, _ in good) and not any(got[i].selected_ for i, _ in bad)
    assert got[5000].log_weight_ == got[5001].log_weight_ == 0 and out.count() == len(good) + len(bad) + len(more)
    assert len({r.sample_key for r in out.filter("doc_id = 7").collect()}) == 1
    long = quality.keyed(spark.createDataFrame([(1, prose(2, 100_000)), (2, "x")], DOCS), target, keep=["doc_id"])
    assert long.columns == ["doc_id", "log_weight", "n_grams", "sample_key"] and {r.doc_id: r.n_grams for r in long.collect()} == {1: 399_998, 2: 2}
    keys = sorted((r.sample_key for r in out.collect()), reverse=True)
    for k in (0, 1, 17, len(keys)):
        drawn = quality.resampled(docs, target, k=k).filter("selected_").count()
        assert drawn == sum(x >= keys[k - 1] for x in keys) if k else drawn == 0
    other = {r.doc_id for r in quality.resampled(docs, target, k=100, seed=1).filter("selected_").collect()}
    assert len(other ^ {r.doc_id for r in quality.resampled(docs, target, k=100).filter("selected_").collect()}) > 20
    assert quality.resampled(docs.limit(0), target).count() == 0
    assert quality.resampled(docs, quality.target_texts(docs, labels.limit(0))).filter("log_weight_ <> 0").count() == 0


def test_gumbel_top_k_draws_in_proportion(spark):
    """Inclusion rates of the two greatest keys over many seeds, against those of drawing twice without replacement."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    weights, seeds = [0.0, 1.0, 1.5, 2.0, -1.0], 20_000
    p = np.exp(weights) / np.exp(weights).sum()
    want = [p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(len(p)) if j != i) for i in range(len(p))]
    each = spark.range(seeds).select(F.col("id").alias("seed"), F.posexplode(F.array(*map(F.lit, weights))).alias("doc_id", "w"))
    keys = each.withColumn("key", F.col("w") + quality.gumbel([F.col("doc_id"), F.lit("text")], F.col("seed")))
    top = keys.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("key")))).filter("n <= 2")
    got = {r.doc_id: r["count"] / seeds for r in top.groupBy("doc_id").count().collect()}
    assert all(abs(got[i] - want[i]) < 0.015 for i in range(len(p)))


def test_log_weights_equal_the_definition(spark):
    """Weights by counting in plain Python, scaled down to GRAMS n-grams."""
    docs = spark.createDataFrame([(i, prose(i, 30 + 5 * i)) for i in range(20)], DOCS)
    target = docs.filter("doc_id < 8").select("text")
    features = {r.doc_id: np.concatenate(list(quality.Hasher().features(r.text))) for r in docs.collect()}
    count = lambda ids: Counter(int(f) for i in ids for f in features[i])
    wanted, raw = count(range(8)), count(range(20))
    n_wanted, n_raw, prior = sum(wanted.values()), sum(raw.values()), quality.BUCKETS
    for r in quality.keyed(docs, target).collect():
        own = features[r.doc_id]
        q = {int(f): raw[int(f)] / n_raw for f in own}
        log = sum(np.log((wanted[int(f)] + prior * q[int(f)]) / (n_wanted + prior) / q[int(f)]) for f in own)
        assert abs(r.log_weight - log * min(1, quality.GRAMS / len(own))) < 1e-6 and r.n_grams == len(own)


# --- 3 ------------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    lines = [
        ("MIT", "alpha beta.\nReleased under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0.\ntail"), ("CC-BY-NC-4.0", "x\nLicensed under CC BY-NC 4.0."),
        ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("", "The Apache helicopter landed under licence."), ("", "MIT students wrote it."), ("", None), ("", ""), ("", "\n \n"),
        ("GPL-3.0,MIT", "Released under the MIT License.\nLicensed under the GNU General Public License, version 3.\nalpha beta"), ("MIT", prose(9, 30_000) + "\n\n\nReleased under the MIT License.\n" + prose(8, 30_000)),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(lines)] + [(100 + i, prose(i, 40)) for i in range(50)] + [(100, prose(0, 40)), (None, lines[0][1])], DOCS)
    rows = licenses.license_scan(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(lines) + 52 and [got[i].families for i in range(len(lines))] == [f for f, _ in lines]
    assert got[0].n_paragraphs == 1 and got[0].licenses[0].line == 1 and got[8].n_paragraphs == 0 and got[10].n_paragraphs == 2 and got[10].licenses[0].asDict()["line"] == 3
    assert all(got[100 + i].families == "" for i in range(50)) and got[None].families == "MIT"
    assert licenses.license_scan(docs.limit(0)).count() == 0
    clash = licenses.scan(docs.selectExpr("*", "1 AS Licenses"), licenses.train([prose(i, 40) for i in range(50)], rounds=5))
    assert clash.columns == ["doc_id", "text", "Licenses", "n_paragraphs", "licenses_"] and clash.filter("Licenses = 1").count() == len(rows)


def test_license_versions_variants_and_wraps():
    import textwrap

    model = licenses.train([prose(i, 40) for i in range(400)])
    notice = {f: n[0] for f, n in licenses.NOTICES.items()}
    texts = [(f, textwrap.fill(notice[f], width)) for f in notice for width in (40, 60, 10_000)]
    texts += [(f, f"alpha beta {t} gamma") for f, t in texts] + [(f, t.replace("free of charge", "at no charge").replace("the Free", "our Free")) for f, t in texts]
    texts += [
        ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0"), ("CC-BY-3.0", "Licensed under CC BY 3.0."), ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
        ("LGPL-2.1", "This library is released under the GNU Lesser General Public License, version 2.1"), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
        ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-3.0", "// SPDX-License-Identifier: GPL-3.0-only"), ("MIT", "This project is licensed under the MIT License."), ("", "Licensed under the GNU General Public License, version 4."), ("GPL", "This code is licensed under the GNU General Public License."),
        ("", "CC BY 2.5"), ("", "Fishing licences are granted to any person over twenty."), ("", "The license of the driver was taken away by the court."), ("", "")
    ]
    texts += [("", "This project is not licensed under the MIT License."), ("BSD", "Released under the BSD License.")]
    assert [f for f, t in texts if ",".join(x["family"] for x in licenses.judged(model, t)[1]) != f] == []
    # The whole texts, clauses as paragraphs: what both share says BSD, and the clause of one alone which.
    head, one, two, three = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", notice3(licenses)
    families = lambda parts, sep: {x["family"] for x in licenses.judged(model, sep.join(parts))[1]}
    assert families([head, one, two], " ") == {"BSD-2-Clause"} and families([head, one, two, three], " ") == {"BSD-3-Clause"}
    assert "BSD-3-Clause" not in families([head, one, two], "\n\n") and families([head, one, two, three], "\n\n") >= {"BSD", "BSD-3-Clause"}


def notice3(licenses):
    return "3. " + licenses.NOTICES["BSD-3-Clause"][1]


def test_paragraphs():
    assert list(licenses.paragraphs_of("")) == [] and list(licenses.paragraphs_of("\n \n")) == []
    assert list(licenses.paragraphs_of("a\nb\n\n \nc")) == [(0, ["a", "b"]), (4, ["c"])] and list(licenses.paragraphs_of("\na\n")) == [(1, ["a"])]


# --- 5 ------------------------------------------------------------------------------------------------------------------


def best_fit(lengths, size):
    caps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(caps, x)
        c = caps.pop(i) if i < len(caps) else size
        n += c == size
        bisect.insort(caps, c - x)
    return n


def test_plan_equals_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(150):
        size = int(rng.choice([5, 16, 60, 4096]))
        lengths = (rng.integers(1, size + 1, rng.integers(0, 300)) ** rng.choice([1, 1])).tolist()
        plan = packing.best_fit_plan(dict(Counter(lengths)), size)
        held = defaultdict(list)
        for length, _, many, first, offset in plan.tolist():
            for i in range(many):
                held[first + i].append((offset, length))
        assert sorted(x for v in held.values() for _, x in v) == sorted(lengths)
        for v in held.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= size
        assert len(held) == best_fit(lengths, size)


def test_chunk_tokenizer_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_path()
    whole, ours = Tokenizer.from_file(path), packing.ChunkTokenizer(path, cached=50)
    texts = ["", "It's THEY'LL 123½ x y", "tab\tx\r\ny  ", "ΣΑΣ İstanbul", "a<|endoftext|>b <|startoftext|>", "é é ́", prose(1, 300), "日本語 text", "\x1cq\x85w", "a" * 3000]
    rng = np.random.default_rng(7)
    alphabet = list("aAbeÉßñ'’sS.,-<|>_0129½ \t\n\r\x0b\x1c\xa0\u2003ΣИжİı日\u0301🙂") + ["<|endoftext|>", "'ll", "'RE", "the", " of "]
    texts += ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(4000)]
    for part in (texts[:5], texts[5:], texts[:0]):
        ids, begins = ours.ids(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == [whole.encode(t, add_special_tokens=False).ids for t in part]


def test_packing(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", sequence_id string")
    monkeypatch.setattr(packing, "SLICE_BYTES", 5000)
    got = packing.pack_documents(docs, tokenizer_path(), 256).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = np.asarray(ids[at : at + 256], dtype="<u4")
            want[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for v in held.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    assert len(held) == best_fit([r.length for r in got], 256)
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0
    clashing = spark.createDataFrame(got).drop("sequence_id", "offset").selectExpr("*", "1 AS _salt", "2 AS _RANK", "3 AS _base", "4 AS _salts")
    salted = packing.pack(clashing, 256, group_rows=3)
    assert salted.columns == [*clashing.columns, "sequence_id", "offset"] and salted.filter("_salt = 1 AND _rank = 2 AND _base = 3 AND _salts = 4").count() == len(got)
    assert len({(r.sequence_id, r.offset) for r in salted.collect()}) == len(got)
    single = docs.filter("doc_id <> 9")
    places = packing.pack_documents(single, tokenizer_path(), 256)
    lengths = {r.sequence_id: len(r.ids) for r in packing.sequences(single, places, tokenizer_path(), 256).collect()}
    assert sum(lengths.values()) == sum(r.length for r in places.collect()) and max(lengths.values()) <= 256


# --- 6 ------------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def reachable(points):
    """Least id reachable over fingerprints at most 2 bits apart."""
    root = {i: i for i, _ in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(points):
        for j, b in points[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_simhash(spark, rows):
    assert [simhash.fingerprint(t, block=7) for _, t in rows if len(t or "") < 2000] == [slow_fingerprint(t) for _, t in rows if len(t or "") < 2000]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    want = reachable(sorted({(i, slow_fingerprint(t)) for i, t in rows}))
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert want[2] == 1 and want[5] == want[6] == 4
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("paired", [2, 8])
def test_simhash_links_crowds(spark, paired):
    rng = np.random.default_rng(1)
    centre, fps = int(rng.integers(0, 2**63)), set()
    for _ in range(150):
        x = centre
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 50)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    points = sorted(enumerate(sorted(fps)))
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, paired=paired)).collect()}
    want, group = reachable(points), defaultdict(set)
    for i, x in points:
        group[roots.get(signed(x), signed(x))].add(i)
    assert {frozenset(g) for g in group.values()} == {frozenset(i for i in want if want[i] == r) for r in set(want.values())}


# --- 7 ------------------------------------------------------------------------------------------------------------------


def test_rule_measures(spark, rows):
    more = [(50, "a b c d e a b c d e f"), (51, "x " * 40), (52, "one\ntwo\none\n\none two\n"), (53, "#$ <b> é|é x"), (54, " a b c d e\n a b c d e ")]
    got = {r.doc_id: r for r in rules.verdicts(spark.createDataFrame([*rows, *more], DOCS)).collect()}
    for i, t in [*rows, *more]:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows, hit = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)), set()
        for j in range(len(w) - 4):
            if windows[tuple(w[j : j + 5])] > 1:
                hit.update(range(j, j + 5))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        assert got[i][1:7] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed), i
        assert not (failed and got[i].kept)
    assert got[1].kept and got[8].kept is not None
    assert rules.verdicts(spark.createDataFrame([], DOCS)).count() == 0
    out = rules.cascade(spark.createDataFrame([(1, "x", 5, 6)], DOCS + ", Kept int, n_words int"))
    assert out.columns == ["doc_id", "text", "Kept", "n_words", "n_words_", *rules.MEASURES[1:], "base_failed", "rejected_by", "kept_"]
    row = tuple(out.first())  # which rule rejects first depends on the measured order
    assert row[:10] == (1, "x", 5, 6, 1, 1, 0, 0, 0, True) and row[10] in ("few_words_or_repeats", "word_length") and row[11] is False


def test_order_changes_no_verdict(spark, rows):
    docs = rules.measures(spark.createDataFrame(rows, DOCS))
    r = rules.standard_rules()
    one, two = (docs.select("doc_id", rules.first_rejection(r, order).isNull().alias("k")).collect() for order in (list(r), list(r)[::-1]))
    assert sorted(one) == sorted(two)


def test_cheap_rules_that_reject_come_first(spark):
    """Against a rule that searches every text many times over, one that rejects as much for nothing; one without hits is last."""
    from pyspark.sql import functions as F

    sample = rules.measures(spark.createDataFrame([(i, prose(i, 2000)) for i in range(200)], DOCS))
    slow = sum((F.regexp_count("text", F.lit(f"(a|b|e)+{i}?[a-z]*x")) for i in range(3)), F.lit(0)) >= 0
    found = rules.measured_order(sample, {"never": F.col("n_words") < 0, "slow": slow, "cheap": F.col("doc_id") % 2 == 0})
    assert [f[0] for f in found] == ["cheap", "slow", "never"] and [f[1] for f in found] == [0.5, 1.0, 0.0]
    assert rules.sampled(sample, 20).count() < 60 and rules.sampled(sample, 500).count() == 200


# --- 8 ------------------------------------------------------------------------------------------------------------------


def test_surrogates(spark):
    texts = [
        (1, "mail und.34@mail7.example.com, again UND.34@MAIL7.EXAMPLE.COM."), (2, "call +1 (017) 555-7713 or +1 017 555 7713"), (3, "ip 97.51.17.173."), (4, "card 9807915762804490### and 9807-9157-6280-4490"),
        (5, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"'), (6, "Dear Mrs Anna Novak and Mr. Novak, Господин Иван Петров"), (7, None), (8, ""), (9, "clean text, version 1.2, year 2024"), (10, "und.34@mail7.example.com"), (10, "und.34@mail7.example.com"),
    ]
    docs = spark.createDataFrame([(*t, 7) for t in texts], DOCS + ", pii_mentions int")
    got = pii.pseudonymise(docs, "k").collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == len(texts) and got[0].pii_mentions == 7
    for secret in ("und.34", "UND.34", "(017)", "1 017", "97.51", "9807915762804490", "9157", "b44e15", "Anna Novak", "Novak", "Иван Петров"):
        assert not any(secret in (t or "") for t in text.values()), secret
    assert text[7] is None and text[8] == "" and text[9] == texts[8][1]
    a, b = re.findall(r"[\w.]+@[\w.]+\w", text[1])
    assert a == text[10] and b == a.upper()
    bracketed, spaced = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4})", text[2]).groups()
    assert re.sub(r"\D", "", bracketed) == re.sub(r"\D", "", spaced)
    plain, dashed = re.fullmatch(r"card (\d{16})### and ([\d-]{19})", text[4]).groups()
    assert plain == dashed.replace("-", "")
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', text[5])
    assert re.fullmatch(r"Dear Mrs \w+ \w+ and Mr\. \w+, Господин [А-Я][а-я]+ [А-Я][а-я]+", text[6])
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_signed_decimals_are_no_phones(spark):
    texts = ["rose +0.123 and +1 2 34, then +0.12345678", "+1 2 34 5 6789 12", "call +683 4000 or +1 (555) 123-4567"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert got[:2] == texts[:2] and "683 4000" not in got[2] and "123-4567" not in got[2]


def test_crowded_entities_settle(spark):
    """All numbers of a first digit and a length, all numbers of two digits, most of a country, many families, many given names in one."""
    from pyspark.sql import functions as F

    entities = [("phone", str(i)) for i in range(1000, 2000)] + [("identity", f"{i:02}") for i in range(100)] + [("family", f"x{i}") for i in range(3000)] + [("name", f"f:g{i} novak") for i in range(300)]
    entities += [("phone", f"+420 {i:04}") for i in range(900)]
    held = spark.createDataFrame(entities, "kind string, canon string")
    made = held.join(pii.attempts(held, "k"), ["kind", "canon"], "left").na.fill(0, ["attempt"])
    made = made.withColumn("d", pii.entity_digest("k", *map(F.col, ("kind", "canon", "attempt"))))
    made = made.withColumn("made", pii.distinguishing(*map(F.col, ("kind", "canon", "attempt", "d")))).collect()
    surrogates = {(r.kind, r.made.lower()) for r in made}
    assert len(made) == len(surrogates) == len(entities) and not surrogates & set(entities)
    assert spark.range(1).select(pii.rendered(F.lit("+1 23-4"), F.lit("phone"), F.lit("567890"))).first()[0] == "+5 67-890"


def test_surrogates_stay_distinct(spark, monkeypatch):
    """Where first surrogates collide, entities go on, and the result is the same by broadcast and by shuffle."""
    original = pii.surrogate

    def crowded(kind, canon, attempt, d):
        from pyspark.sql import functions as F

        return F.when(attempt < 2, "clash@example.net").otherwise(original(kind, canon, attempt, d))

    monkeypatch.setattr(pii, "surrogate", crowded)
    docs = spark.createDataFrame([(i, f"a{i}@b.example c{i}@b.example") for i in range(20)], DOCS)
    one = sorted(r.text for r in pii.pseudonymise(docs, "k").collect())
    mails = [m for t in one for m in t.split()]
    assert len(set(mails)) == 40 and not any(m.endswith("b.example") for m in mails)
    monkeypatch.setattr(pii, "BROADCAST_ENTRIES", 0)
    assert sorted(r.text for r in pii.pseudonymise(docs, "k").collect()) == one


def test_names_keep_families_when_given_names_go_on(spark):
    """100 given names of one family: all distinct, one family name in all, in mentions with a given name and without."""
    rng = np.random.default_rng(3)
    given = ["".join(rng.choice(list("abcdefgh"), 6)).capitalize() for _ in range(100)]
    docs = spark.createDataFrame([(i, f"Mr {g} Novak met Mr Novak and Mrs {g} Novak") for i, g in enumerate(given)], DOCS)
    got = [r.text for r in pii.pseudonymise(docs, "k").collect()]
    parts = [re.fullmatch(r"Mr (\w+) (\w+) met Mr (\w+) and Mrs (\w+) (\w+)", t).groups() for t in got]
    assert len({x for p in parts for x in (p[1], p[2], p[4])}) == 1 and "Novak" not in {p[1] for p in parts}
    assert len({p[0] for p in parts}) == len({p[3] for p in parts}) == 100


def test_surrogates_keep_type_and_format(spark):
    """Country codes, the Luhn check, IPv6 groups; and distinctness and coreference over many entities, by brute force."""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10
    cards = [n for n in map(str, range(4000123412340000, 4000123412340200)) if luhn(n) == 0]
    phones = [f"+420 601 {i:03} {j:03}" for i in range(10) for j in range(10)]
    addresses = [f"2001:db8:0:0:0:0:0:{i:x}" for i in range(30)] + [f"fe80:1::{i:x}" for i in range(30)]
    entities = cards + phones + addresses
    docs = [(i, f"x {e} y") for i, e in enumerate(entities)] + [(1000 + i, f"again: {e}") for i, e in enumerate(entities)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(docs, DOCS), "k").collect()}
    made = [got[i][2:-2] for i in range(len(entities))]
    assert made == [got[1000 + i][7:] for i in range(len(entities))] and len(set(made)) == len(made) and not set(made) & set(entities)
    assert all(re.fullmatch(r"\d{16}", m) and luhn(m) == 0 for m in made[: len(cards)])
    assert all(re.fullmatch(r"\+420 \d{3} \d{3} \d{3}", m) for m in made[len(cards) : len(cards) + 100])
    assert all(re.sub("[0-9a-f]", "h", m) == re.sub("[0-9a-f]", "h", e) for m, e in zip(made[-60:], addresses, strict=True))


def test_long_entities_and_clashing_columns(spark):
    long = "x@y" + ".z" * 100_000
    texts = [(1, long), (2, "9" * 200_000), (3, "a" * 200_000 + "@b.cc"), (4, "Mr Novak " * 20_000), (5, "1 " * 100_000), (6, "+1 " * 50_000), (7, "1:" * 50_000), (8, prose(1, 100_000))]
    docs = spark.createDataFrame([(*t, 7, 8, 9, 10) for t in texts], DOCS + ", _mentions int, _ID int, _attempts int, _hash int")
    out = pii.pseudonymise(docs, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*docs.columns, "pii_mentions"] and all(tuple(r)[2:6] == (7, 8, 9, 10) for r in got.values())
    assert got[1].pii_mentions == got[3].pii_mentions == 1 and re.fullmatch(r".@\w{8}\.example\.net", got[1].text) and re.fullmatch(r"\w{64}@\w{8}\.example\.net", got[3].text) and got[4].pii_mentions == 20_000
    assert got[8].text == texts[7][1] and got[2].text == texts[1][1]


def test_what_is_found_and_what_is_not(spark):
    """Mentions by hand; nothing else in a text changes."""
    found = {
        "call 555 223 4567 now": ["555 223 4567"],
        "Dr. Alice Smith and Prof Petr Hora": ["Dr. Alice Smith", "Prof Petr Hora"],
        "MR means Mr JOHN SMITH, Mr O'Brien's car, Ms McDonald, Mr J. K. Hill": ["Mr JOHN SMITH", "Mr O'Brien", "Ms McDonald", "Mr J. K. Hill"],
        "pay GB82 WEST 1234 5698 7654 32 or DE89370400440532013000.": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
        "NO93 8601 1117 947": ["NO93 8601 1117 947"],
        "host 10.1.2.3": ["10.1.2.3"],
    }
    clean = ["Mr President, Ms Office, Ms Windows, Sr Software Engineer, Mr Mr", "version v1.2.3.4", "rows 223 445 6677 88 and 100 200 3000", "IN20 YEARS THIS WORD LIST", "AB12 CDEF", "Drum Profile Dr", ""]
    frame = spark.createDataFrame(list(enumerate([*found, *clean])), "doc_id long, text string")
    from pyspark.sql import functions as F

    got = [r.m for r in frame.select("doc_id", pii.mentions(F.col("text")).alias("m")).orderBy("doc_id").collect()]
    assert got == [*found.values(), *([[]] * len(clean))]
    out = [r.text for r in pii.pseudonymise(frame, "k").orderBy("doc_id").collect()]
    assert out[len(found) :] == clean
    for new, (old, mentioned) in zip(out, found.items(), strict=False):
        kept = re.split("|".join(map(re.escape, mentioned)), old)
        assert re.fullmatch("(.+)".join(map(re.escape, kept)), new) and not any(m in new for m in mentioned), (old, new)
    assert re.search(r"Mr [A-Z]+ [A-Z]+,", out[2]) and re.fullmatch(r"NO\d\d \d{4} \d{4} \d{3}", out[4])


def test_accounts_have_valid_check_digits(spark):
    ibans = ["GB82WEST12345698765432", "DE89370400440532013000", "NO9386011117947", "FR1420041010050500013M02606", "MT84MALT011000012345MTLCAST001S"]
    docs = [(i, f"{n}; {' '.join(n[k : k + 4] for k in range(0, len(n), 4))}") for i, n in enumerate(ibans)]
    for r in pii.pseudonymise(spark.createDataFrame(docs, DOCS), "k").collect():
        plain, spaced = r.text.split("; ")
        old = ibans[r.doc_id]
        assert plain == spaced.replace(" ", "") != old and plain[:2] == old[:2] and r.pii_mentions == 2
        assert re.sub("[A-Z]", "A", re.sub(r"\d", "0", plain[4:])) == re.sub("[A-Z]", "A", re.sub(r"\d", "0", old[4:]))
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_families_named_again(spark):
    """A family named with a title gets its surrogate where it stands alone in that document, and there only."""
    texts = [(1, "Novak spoke. Mrs Anna Novak's car; NOVAK, novak, Novakova and Novak's dog. Mr Li met Li."), (2, "Novak alone"), (3, "Dr Gor met Mr Novak: Novak and Gor.")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(texts, DOCS), "k").collect()}
    a, b, c, d, e = re.fullmatch(r"(\w+) spoke\. Mrs \w+ (\w+)'s car; (\w+), novak, Novakova and (\w+)'s dog\. Mr (\w+) met Li\.", got[1].text).groups()
    assert a == b == d and c == a.upper() and a != "Novak" and e != "Li" and got[1].pii_mentions == 2
    assert got[2].text == "Novak alone"
    gor, novak, n2, g2 = re.fullmatch(r"Dr (\w+) met Mr (\w+): (\w+) and (\w+)\.", got[3].text).groups()
    assert novak == n2 == a and gor == g2 != "Gor"


def test_short_phones_settle(spark):
    texts = [(i, f"+1 {a}{b} {c}{d} 12 34") for i, (a, b, c, d) in enumerate(np.ndindex(10, 10, 10, 10)) if i % 10 == 0]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(texts, DOCS), "k").collect()]
    digits = {re.sub(r"\D", "", t) for t in got}
    assert len(digits) == len(texts) and not digits & {re.sub(r"\D", "", t) for _, t in texts}


# --- 9 ------------------------------------------------------------------------------------------------------------------


def test_url_lists(spark):
    from datetime import datetime as D

    ts = lambda day: D(2024, 1, day)
    changes = spark.createDataFrame(
        [("x.org", "bad", ts(2), "add"), ("x.org", "bad", ts(3), "add"), ("x.org", "bad", ts(5), "remove"), ("a.x.org", "ads", ts(1), "add"), ("y.org", "bad", ts(4), "remove"), (None, "bad", ts(1), "add"), ("z.org", "bad", ts(9), "add"), ("z.org", "bad", ts(9), "remove")],
        "domain string, category string, ts timestamp, action string",
    )
    captures = [(1, "http://A.X.org:80/p", ts(2)), (2, "https://x.org", ts(5)), (3, "https://x.org/", ts(4)), (4, "http://q@b.y.org./", ts(5)), (5, None, ts(4)), (6, "nothing", ts(4)), (7, "http://x.org", None), (8, "http://z.org", ts(9)), (9, "http://notx.org", ts(4)), (10, "http://a.x.org", D(2025, 1, 1))]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetch_ts timestamp")
    for bucket in (3600, 30 * 86400):
        got = {r.page_id: (r.n_active, r.categories, r.blocked) for r in urls.judged(frame, changes, bucket).collect()}
        none = (0, "", False)
        assert got == {1: (2, "ads,bad", True), 2: none, 3: (1, "bad", True), 4: none, 5: none, 6: none, 7: none, 8: none, 9: none, 10: (1, "ads", True)}
    twice = urls.judged(frame.unionByName(frame), changes).collect()
    assert len(twice) == 2 * len(captures) and {r.page_id: (r.n_active, r.categories, r.blocked) for r in twice} == got
    assert urls.judged(frame, changes.limit(0)).filter("blocked").count() == 0
    assert urls.judged(frame.limit(0), changes).count() == 0


# --- 10 -----------------------------------------------------------------------------------------------------------------


def slow_contamination(rows, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, t in rows:
        w, hit, names = split(t), set(), set()
        for item, text in items:
            v = split(text)
            k = min(window, len(v))
            own = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for j in range(len(w) - k + 1 if v else 0):
                if tuple(w[j : j + k]) in own:
                    hit.update(range(j, j + k))
                    names.add(str(item))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, rows, monkeypatch):
    items = [(1, prose(7, 40)), (2, prose(1, 120)[50:200]), (3, "Tiny PHRASE, here"), (4, ""), (5, None), (10, "éa-b"), (11, prose(8, 9)), (11, prose(9, 12))]
    more = [(60, "before " + prose(7, 40)[20:160] + " after"), (61, "so tiny phrase! Here it is"), (62, "ÉA b éa b"), (63, prose(8, 9) + "\n" + prose(9, 12)), (64, prose(7, 40) * 2)]
    docs = spark.createDataFrame([*rows, *more], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = slow_contamination([*rows, *more], items)
    for block in (2_000_000, 40):
        marked = decontam.mark(docs, bench, block_words=block)
        from pyspark.sql import functions as F

        got = marked.select("doc_id", "n_words", decontam.hit_words(F.col("hit_spans")), F.size("item_ids"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256), F.size("hit_spans") > 0)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == (1 if block > 40 else 0)  # blocks are passes of their own, not a chain of workers
    assert sorted((tuple(r)[:6] for r in decontam.report(docs, bench).collect()), key=str) == want
    best = {r.doc_id: r.matches for r in decontam.report(docs, bench).collect()}
    assert best[61][0].asDict() == {"item_id": "3", "doc_word": 1, "item_word": 0, "n_words": 3}
    assert {m.item_id: m.n_words for m in best[64]}["1"] == 39  # the two copies share a word
    clean = decontam.decontaminate(docs.withColumn("matches", F.lit(1)), bench)
    assert clean.columns == ["doc_id", "text", "matches"] and clean.count() == sum(not r[5] for r in want)
    assert decontam.report(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.report(docs.limit(0), bench).count() == 0


def slow_longest(w, v):
    """Length of the longest run of words in both, by the table of common suffixes."""
    best, row = 0, [0] * (len(v) + 1)
    for x in w:
        row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(v))]
        best = max(best, *row)
    return best


def test_longest_matches_equal_brute_force():
    rng = np.random.default_rng(5)
    for words in (1, 2, 3, 30):
        for _ in range(40):
            passages = [rng.integers(1, words + 1, rng.integers(1, 40)) for _ in range(rng.integers(1, 4))]
            items = [rng.integers(1, words + 1, rng.integers(1, 30)) for _ in range(rng.integers(1, 4))]
            for (p, a, o, n), v in zip(decontam.longest_matches(passages, items), items, strict=True):
                assert n == max(slow_longest(w.tolist(), v.tolist()) for w in passages)
                assert n == 0 or passages[p][a : a + n].tolist() == v[o : o + n].tolist()


def test_repeated_words_cost_no_pairs(spark):
    """An item of one word over and over, in texts of that word: linear, where places times owners would be hundreds of millions."""
    docs = spark.createDataFrame([(i, "na " * (20_000 + i)) for i in range(3)] + [(9, "na na"), (10, None)], DOCS)
    bench = spark.createDataFrame([(i, "na " * 4000) for i in range(50)] + [(99, None)], "item_id long, text string")
    import time

    began = time.time()
    got = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
    assert time.time() - began < 60
    assert [got[i].n_hit for i in (0, 1, 2, 9, 10)] == [20_000, 20_001, 20_002, 0, 0] and got[0].n_items == 50
    assert {m.n_words for m in got[1].matches} == {4000}


def test_common_passage_in_many_items(spark):
    passage = prose(40, 14)
    items = [(i, f"{prose(1000 + i, 20)} {passage} {prose(2000 + i, 20)}") for i in range(60)]
    rows = [(i, f"{prose(3000 + i, 30)} {passage} {prose(4000 + i, 30)}") for i in range(40)]
    got = decontam.report(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == slow_contamination(rows, items)
