"""Filter interaction audit: what every order of five document filters keeps, removes and loses.

A document becomes one 32-bit truth-table word: bit S is set if it survives all the filters of subset S. Tasks add words bit by
bit with carry-save adders (positional popcounts), so that a part's survivors of all 32 subsets come from one pass; every order,
and the Shapley share, follows from these 32 numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import SPACE

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Groups of part and label that a task holds before it gives their counts away.
HELD_GROUPS = 4096


def failures(text: Column) -> dict[str, Column]:
    """The conditions on one text by itself: A short, B repetitive, C capitals, D symbols."""
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {"A": n < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic (booleans) and fails (a bit for each filter) of every row of docs (doc_id, text, source).

    Null texts and sources are empty. E: the same text (equal 128 bits of MD5) has a row with a smaller doc_id; a null doc_id is
    neither smaller nor larger than another, so such a row never fails E. An id that labels repeats has a label if any of its rows has."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    bits = sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failures(F.col("text")).items()), F.lit(0))
    own = own.select("doc_id", "part", bits.alias("alone"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"))
    # The first id of each text: joined by text and id together, so that the copies of one text spread over all tasks.
    first = own.filter("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    out = own.join(first, ["same", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("part", flag("good"), flag("toxic"), (F.col("alone") + copy).alias("fails"))


def survival_word(fails: np.ndarray) -> np.ndarray:
    """For each set of failed filters the 32-bit word whose bit S tells whether S holds none of them."""
    table = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], dtype=np.uint32)
    return table[fails]


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits: carry-save adders turn three words of one weight into a sum of that weight and a
    carry of the next, until one word of each weight is left."""
    counts, weight = np.zeros(32, dtype=np.int64), 0
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            words = np.concatenate([odd ^ c, words[3 * third :]])
        if len(words) == 2:
            carries.append(words[:1] & words[1:])
            words = words[:1] ^ words[1:]
        counts += ((words[0] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).astype(np.int64) << weight
        words, weight = np.concatenate(carries) if carries else words[:0], weight + 1
    return counts


_COUNTED = pa.schema([("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("survivors", pa.list_(pa.int64()))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}

    def told() -> pa.RecordBatch:
        rows = [{"part": p, "good": g, "toxic": t, "survivors": c.tolist()} for (p, g, t), c in held.items()]
        held.clear()
        return pa.RecordBatch.from_pylist(rows, schema=_COUNTED)

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        names, codes = parts.dictionary.to_pylist(), parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        good, toxic, fails = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
        group = codes * 4 + good * 2 + toxic
        order = np.argsort(group, kind="stable")
        begins = np.flatnonzero(np.diff(group[order], prepend=-1))
        for own in np.split(order, begins[1:]) if len(order) else []:
            g = int(group[own[0]])
            key = (names[g // 4], bool(g & 2), bool(g & 1))
            held[key] = held.get(key, 0) + positional_popcount(survival_word(fails[own]))
        if len(held) > HELD_GROUPS:
            yield told()
    if held:
        yield told()


def survivors(judged_rows: DataFrame) -> DataFrame:
    """A row for each part: survivors of each of the 32 subsets, of all documents (n), good ones (g) and toxic ones (t)."""
    rows = judged_rows.mapInArrow(_counted, "part string, good boolean, toxic boolean, survivors array<long>")
    long = rows.select("part", "good", "toxic", F.posexplode("survivors").alias("subset", "x"))
    count = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("x"))), F.lit(0)).alias(name)
    each = long.groupBy("part", "subset").agg(F.sum("x").alias("n"), count(F.col("good"), "g"), count(F.col("toxic"), "t"))
    rank = F.array_sort(F.collect_list(F.struct("subset", "n", "g", "t")))  # 32 entries
    return each.groupBy("part").agg(rank.alias("s")).select("part", *(F.col("s")[k].alias(k) for k in "ngt"))


def _steps() -> list[dict]:
    """filter_order, step, and the subsets before and after the step and of its filter alone, of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append({"filter_order": "".join(order), "step": step, "b": before, "a": before | bit, "f": bit})
            before |= bit
    return out


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Repeated rows count each. Columns beside doc_id, text and source do not matter. An empty table gives no rows."""
    # Each subset's survivors are one column of a row a part; the orders are a fixed list of 600 steps.
    per_part = survivors(judged(docs, labels))
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,b:int,a:int,f:int>>")
    full, factorial = SUBSETS - 1, (24, 6, 4, 6, 24)  # |S|! (4 - |S|)! for |S| of 0 to 4
    without = lambda f: [s for s in range(SUBSETS) if not s & f]
    n = F.col("n")
    shapley = lambda f: sum((factorial[s.bit_count()] * (n[s] - n[s | f]) for s in without(f)), F.lit(0))
    shares = F.create_map(*(x for i in range(len(FILTERS)) for x in (F.lit(1 << i), shapley(1 << i))))
    c = F.col
    removed = n[c("x.b")] - n[c("x.a")]
    lost = lambda k: c(k)[c("x.b")] - c(k)[c("x.a")]
    rows = per_part.withColumn("shares", shares).withColumn("x", F.explode(steps))
    return rows.select(
        "part", "x.filter_order", "x.step",
        n[c("x.a")].alias("kept"), removed.alias("removed"), (n[0] - n[c("x.f")] - removed).alias("redundant"),
        (n[F.lit(full) - c("x.f")] - n[full]).alias("unique_fails"), lost("g").alias("good_lost"), lost("t").alias("toxic_lost"), c("shares")[c("x.f")].alias("shapley"),
    )


SQL = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
m AS (SELECT text, min(doc_id) AS least FROM d GROUP BY 1),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
w AS (SELECT d.*, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 50 AS A, 100 * len(list_distinct(ws)) < 65 * len(ws) AS B,
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D, coalesce(w.doc_id > least, false) AS E
  FROM w JOIN m USING (text) LEFT JOIN l ON l.doc_id = w.doc_id),
k AS (SELECT part, good, toxic, [A, B, C, D, E] AS fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM x a JOIN x b ON b.i <> a.i JOIN x c ON c.i NOT IN (a.i, b.i) JOIN x d ON d.i NOT IN (a.i, b.i, c.i) JOIN x e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
s AS (SELECT ord, array_to_string(list_transform(ord, lambda i: substr('ABCDE', i + 1, 1)), '') AS filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
t AS (SELECT part, filter_order, step, n, good, toxic, ord[step] AS own, len(list_filter(ord[:step - 1], lambda i: fails[i + 1])) > 0 AS gone, fails[ord[step] + 1] AS failing,
  len(list_filter(fails, lambda y: y)) AS many FROM s, k),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing AND many = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost FROM t GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
