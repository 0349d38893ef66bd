"""SimHash near-duplicate detection by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most 2 bits agree, but for at most one bit, in one of their two halves. So
each distinct fingerprint is indexed under its halves with one bit wiped out (64 variants), and an equality join on the
variants finds every pair. A bucket of many fingerprints is not paired up: its members are indexed again under
the 65 points of the balls of one bit around them. Two fingerprints share a point just if they are within 2 bits of each
other, and a point has at most 65 of them, so these links need no check and stay in proportion to the fingerprints. Copies
share a fingerprint and are joined in before any pairing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.common import stored

SEED = 42
SHINGLE = 3
HALF = 32
#: Buckets of one-bit variants up to this size are paired up; the members of larger ones go through balls.
PAIRED = 8


def fingerprint(text: str | None, shingle: int = SHINGLE, block: int = 1 << 16) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words. Long texts go through in blocks."""
    words = (text or "").encode().lower().split()  # of bytes: lower() and split() know ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join, ones = xxhash.xxh64_intdigest, b" ".join, np.zeros(64, dtype=np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, block):
        part = words[at : at + block + shingle - 1]
        hashes = np.array([digest(join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)), strict=False)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and the carried columns (longs). Null text counts as a text without words.
    Repeated rows stay."""
    names = ["doc_id", "fp", *carried]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits), *batch.columns[2:]], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text", *carried).mapInArrow(score, ", ".join(f"{n} long" for n in names))


def _half(fp, half: int):
    return F.shiftrightunsigned(fp, HALF) if half else fp.bitwiseAND(F.lit((1 << HALF) - 1))


def one_bit_variants(fps: DataFrame) -> DataFrame:
    """fp, key: for each half and each of its bits, the half without that bit, tagged with half and bit."""
    keys = [
        _half(F.col("fp"), half).bitwiseAND(F.lit(((1 << HALF) - 1) & ~(1 << bit))).bitwiseOR(F.lit((half * HALF + bit) << HALF))
        for half in (0, 1)
        for bit in range(HALF)
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def balls(fps: DataFrame) -> DataFrame:
    """fp, point: the fingerprint and all points one bit from it. Fingerprints have a point in common just if they are within
    2 bits of each other, and no point has more than 65 of them."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << bit)).cast("long") for bit in range(64)))
    return fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp, stored) that connect all that are within 2 bits: all such pairs of small
    buckets, and for fingerprints in larger ones each with the least at every point of its ball."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    bucket = Window.partitionBy("key")
    counted = one_bit_variants(fps).withColumns({"n": F.count("*").over(bucket), "a": F.min("fp").over(bucket), "b": F.max("fp").over(bucket)})
    held = stored(counted.filter("n > 1"))
    two = held.filter("n = 2 and fp = a").select("a", "b").filter(near)
    some = held.filter(f"n > 2 and n <= {paired}").select("key", "fp")
    pairs = some.withColumnRenamed("fp", "a").join(some.withColumnRenamed("fp", "b"), "key").filter("a < b").filter(near).select("a", "b")
    crowd = balls(held.filter(f"n > {paired}").select("fp").distinct()).withColumn("a", F.min("fp").over(Window.partitionBy("point")))
    return two.unionByName(pairs).unionByName(crowd.filter("a < fp").select("a", F.col("fp").alias("b"))).distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) of an undirected graph of pairs (a, b), by alternating large and small stars.

    Each round hangs neighbours under the least one they know; all state stays in stored tables. Ends when nothing changes."""
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    told = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = stored(small, instead_of=edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == told:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes (column fp, distinct; stored) with root, the least fingerprint of each one's component."""
    roots = components(links(nodes.select("fp")))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints that differ in at most 2 bits.

    Texts without words (null, empty, blank) have fingerprint 0 and are linked like any other. Repeated rows each give a row;
    a null doc_id takes part but is never a component's id unless the component has no other. An empty table gives none."""
    held = stored(fingerprints(docs))
    nodes = stored(held.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = rooted(nodes)
    ids = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = found.join(ids, "root").select("fp", "component_id")
    return held.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keepers(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and n (rows that have both) of one row of every component: that with the least
    doc_id, nulls last, then the least fingerprint and text hash."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = fingerprints(hashed, "text_hash").groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "text_hash", "n")
    found = rooted(stored(rows.groupBy("fp").agg(F.min(first).alias("first"))))
    return found.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash", "first.n")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
