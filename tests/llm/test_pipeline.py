"""The pipeline's stages against brute-force versions, on a small corpus."""

from __future__ import annotations

import corpus_pipeline as P
from test_operators import prose, reachable, slow_contamination, slow_fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    good = [(i, prose(i, 150)) for i in range(90)]
    docs = good + [(100, good[3][1]), (101, " ".join(f"{w}###" for w in prose(500, 60).split())), (102, prose(300, 30) + " " + prose(777, 40)), (103, prose(301, 200) + " mail a.b@c.example.org"), (104, None)]
    docs += [(200 + i, " ".join(f"{w}###" for w in prose(600 + i, 80).split())) for i in range(30)]
    folder = str(tmp_path)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in [*range(90), 100, 102, 103]] + [(101, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench = [(1, prose(777, 40))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    assert [n for n, _ in P.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "best_fit_packing"] and P.ORACLE_SQL is None
    at = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, at, folder)
        assert out.columns == at.columns
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (at, out))
        if name == "quality_classifier":
            assert not {101, *range(200, 230)} & set(after) and {i for i, _ in good} <= set(after)
        elif name == "simhash_near_dedup":
            want = reachable(sorted((i, slow_fingerprint(t)) for i, t in before.items()))
            assert set(after) == {i for i in want if want[i] == i} and 100 not in after
        elif name == "benchmark_decontamination":
            assert set(after) == {r[0] for r in slow_contamination(before.items(), bench) if not r[5]} and 102 not in after
        else:
            assert set(after) == set(before) and "a.b@c" not in after[103]
            assert all(after[i] == before[i] for i in before if i != 103)
        kept.append(len(after))
        at = out
    last = P.run(spark, folder)
    assert {r.doc_id for r in last.collect()} == set(after)


def test_repeated_rows_and_empty(spark, tmp_path):
    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (2, prose(3, 50))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], COLUMNS)
    got = P.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted({r for r in rows})  # the two texts of id 2 are no copies
    assert P.near_dedup(spark, docs.limit(0), "").count() == 0


def test_every_group_keeps_a_row(spark):
    """Null ids, and an id whose two texts lie in two groups, one of them with another id."""
    a, b, c, d = (prose(i, 50) for i in (11, 12, 13, 14))
    rows = [(None, a), (None, a), (None, b), (5, c), (5, d), (7, d), (None, d), (4, c), (9, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], COLUMNS)
    got = P.near_dedup(spark, docs, "").collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in got)) == sorted([(0, a), (0, b), (4, c), (5, d), (9, "")])
    shared = docs.filter("doc_id = 5")
    assert sorted(r.text for r in P.near_dedup(spark, shared.unionByName(shared), "").collect()) == sorted([c, d])


def test_empty_corpus_and_clashing_columns(spark, tmp_path):
    """No documents, labels or items at all; then documents without ids, repeated ones, and columns named like the stages' own."""
    extra = ", selected int, log_weight int, _mentions int, _hash int, _ID int, fp int, n_words int, sequence_id int"
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], COLUMNS + extra).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    rows = [(None, prose(1, 60)), (1, prose(2, 60)), (1, prose(2, 60)), (2, None), (3, "mail a.b@c.example.org " + prose(3, 60)), (4, prose(4, 30_000))]
    docs = spark.createDataFrame([(*r, "en", "s", 1, *range(8)) for r in rows], COLUMNS + extra)
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == (COLUMNS + extra).replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 2, 3, 4] and docs.filter("text LIKE '%a.b@c%'").count() == 0
    assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {None, 1, 2, 3, 4}
