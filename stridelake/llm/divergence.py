"""Source divergence audit: how far the word frequencies of a language's sources lie apart, and which terms make the difference.

A first pass counts in how many documents of its language each term is, exactly. The terms that stay get minimal perfect hashes,
built on the executors in shards of bounded size: each shard gives its terms dense slots and keeps the terms themselves, so that a
term that did not stay is told by comparison. The second pass holds the shards by broadcast, in blocks of a bounded number of
bytes, and adds up counts in a dense array of slots for each (language, source).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.common import stored

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
#: Ranks of part `term`.
RANKS = 200
#: Terms of a shard, about; bytes of terms and hashes that are broadcast at a time; slots of four bytes that a task holds.
SHARD_KEYS, BLOCK_BYTES, HELD_SLOTS = 1 << 16, 64 << 20, 1 << 24
#: Terms a task of the first pass holds before it gives their counts away.
HELD_TERMS = 400_000
#: What a shard takes for a term beside its bytes: hash levels, ranks and an offset.
TERM_COST = 8
#: Groups of documents beyond this number are joined by a shuffle instead of a broadcast.
BROADCAST_GROUPS = 100_000
#: ASCII letters in lower case and bytes of other characters stay, all else separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MASK = (1 << 64) - 1


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _hashes(terms: list[bytes]) -> np.ndarray:
    """What F.xxhash64 gives, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), dtype=np.uint64, count=len(terms))


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    x = hashes ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """A minimal perfect hash in levels: a key has the first level at whose bit it stands alone, and its slot is the number of set
    bits before. Keys that share all 64 bits of their hash come after these, in `spare`."""

    levels: list[np.ndarray]
    ranks: list[np.ndarray] = field(default_factory=list)
    spare: int = 0

    def __post_init__(self) -> None:
        at = 0
        for words in self.levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(at + np.cumsum(counts) - counts)
            at += int(counts.sum())
        self.spare = at

    @classmethod
    def of(cls, hashes: np.ndarray, most_levels: int = 64) -> PerfectHash:
        levels, left = [], hashes
        while len(left) and len(levels) < most_levels:
            size = 64 * (len(left) * 2 // 64 + 1)
            at = _places(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").copy())
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot that each hash would have; -1 for a hash of no level. Foreign hashes may get any slot."""
        out, open_ = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _places(hashes[open_], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            got = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[got]] = (ranks[at >> 6] + before)[got]
            open_ = open_[~got]
        return out


@dataclass
class Shard:
    hash: PerfectHash
    terms: pa.Array

    @classmethod
    def of(cls, terms: list[bytes]) -> Shard:
        hashes = _hashes(terms)
        made = PerfectHash.of(hashes)
        slots = made.slots(hashes)
        rest = np.flatnonzero(slots < 0)
        slots[rest] = made.spare + np.arange(len(rest))
        return cls(made, pa.array(terms, pa.binary()).take(pa.array(np.argsort(slots))))

    def slots(self, terms: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The slot of each term, verified against the stored one; -1 for terms that the shard has not."""
        out = self.hash.slots(hashes)
        known = np.flatnonzero(out >= 0)
        if len(known):
            same = pc.equal(self.terms.take(pa.array(out[known])), terms.take(pa.array(known))).to_numpy(zero_copy_only=False)
            out[known[~same]] = -1
        if self.hash.spare < len(self.terms):
            more = pc.index_in(terms.take(pa.array(missed := np.flatnonzero(out < 0))), value_set=self.terms.slice(self.hash.spare))
            found = more.is_valid().to_numpy(zero_copy_only=False)
            out[missed[found]] = self.hash.spare + pc.fill_null(more, 0).to_numpy(zero_copy_only=False)[found]
        return out


def _own(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def kept_terms(own: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term (bytes) of the terms in at least `least` documents (rows) of the language: counted exactly, with what a task
    counts added up before the shuffle."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang].update(set(terms_of(text)))
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield from told()
        yield from told()

    counted = own.select("lang", "text").mapInArrow(documents, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def perfect_hashes(vocabulary: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """A row for each shard of a language's terms: lang, shard, shards (how many the language has), levels, terms (by slot), bytes."""
    many = vocabulary.groupBy("lang").agg(F.ceil(F.count("*") / shard_keys).cast("int").alias("shards"))
    dealt = vocabulary.join(many, "lang").withColumn("shard", F.pmod(F.shiftrightunsigned(F.xxhash64("term"), 33), F.col("shards")).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = Shard.of(part["term"].tolist())
        terms = made.terms.to_pylist()
        row = {"lang": part["lang"].iat[0], "shard": int(part["shard"].iat[0]), "shards": int(part["shards"].iat[0])}
        return pd.DataFrame([row | {"levels": [x.tobytes() for x in made.hash.levels], "terms": terms, "bytes": sum(map(len, terms)) + TERM_COST * len(terms)}])

    return dealt.groupBy("lang", "shard").applyInPandas(build, "lang string, shard int, shards int, levels array<binary>, terms array<binary>, bytes long")


@dataclass
class Block:
    """Shards of a broadcast: of each language a run of its shards, the first slot of which is `first`."""

    shards: dict[str, dict[int, tuple[Shard, int]]]
    many: dict[str, int]
    first: dict[str, int]
    width: dict[str, int]

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        out = cls(defaultdict(dict), {}, {}, defaultdict(int))
        for i in range(rows.num_rows):
            lang, shard, shards, start = (rows.column(c)[i].as_py() for c in ("lang", "shard", "shards", "start"))
            levels = [np.frombuffer(x, dtype="<u8").copy() for x in rows.column("levels")[i].as_py()]
            terms = pa.concat_arrays([rows.column("terms")[i].values])  # a copy of its own
            out.shards[lang][shard] = (Shard(PerfectHash(levels), terms), start)
            out.many[lang] = shards
            out.first[lang] = min(out.first.get(lang, start), start)
            out.width[lang] += len(terms)
        return out

    def slots(self, lang: str, terms: list[bytes]) -> np.ndarray:
        """Slots within the language, -1 for terms that did not stay or that are in another block."""
        hashes, held = _hashes(terms), pa.array(terms, pa.binary())
        shard = ((hashes >> np.uint64(33)) % np.uint64(self.many[lang])).astype(np.int64)
        out, order = np.full(len(terms), -1, dtype=np.int64), np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if (found := self.shards[lang].get(int(shard[own[0]]))) is not None:
                slots = found[0].slots(held.take(pa.array(own)), hashes[own])
                out[own] = np.where(slots >= 0, slots + found[1], -1)
        return out


def _recounted(held):
    """Counts of one block's terms, as rows of lang, source, slots and counts."""
    names = ["lang", "source", "slots", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        dense: dict[tuple[str, str], np.ndarray] = {}
        room, words = HELD_SLOTS, 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                slots = np.flatnonzero(counts)
                for at in range(0, len(slots), 4096):
                    some = slots[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.array([some + block.first[lang]], pa.list_(pa.int64())), pa.array([counts[some]], pa.list_(pa.int64()))], names=names)
            dense.clear()

        for batch in batches:
            groups: dict[tuple[str, str], Counter] = defaultdict(Counter)
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if lang in block.many:
                    groups[lang, source].update(terms_of(text))
            slots_of: dict[str, dict[bytes, int]] = {}
            for lang in {lang for lang, _ in groups}:  # each term once, however many sources have it
                every = list(set().union(*(counts for (own, _), counts in groups.items() if own == lang)))
                slots_of[lang] = dict(zip(every, block.slots(lang, every).tolist(), strict=True))
            for key, counts in groups.items():
                width, n = block.width[key[0]], counts.total()
                if (key not in dense and dense and width > room) or words + n >= 1 << 32:  # four bytes hold a count
                    yield from told()
                    room, words = HELD_SLOTS, 0
                if key not in dense:
                    dense[key] = np.zeros(width, dtype=np.uint32)
                    room -= width
                slots = np.fromiter(map(slots_of[key[0]].__getitem__, counts), dtype=np.int64, count=len(counts))
                kept = slots >= 0
                dense[key][slots[kept] - block.first[key[0]]] += np.fromiter(counts.values(), dtype=np.int64, count=len(counts))[kept].astype(np.uint32)
                words += n
        yield from told()

    return count


def recount(own: DataFrame, shards: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, slot, n), where n > 0, of all kept terms, and the slots' terms (lang, slot, term).

    Slots number the terms of a language from 0 without gaps. A shard is a row for some 65,000 terms; of these rows only sizes
    come to the driver, and terms in blocks of about `block_bytes`, each with a pass of its own whose counts are stored."""
    spark = own.sparkSession
    sizes = sorted(tuple(r) for r in shards.select("lang", "shard", F.size("terms"), "bytes").collect())
    starts: dict[str, int] = defaultdict(int)
    placed, used, block = [], 0, 0
    for lang, shard, n, size in sizes:
        if used and used + size > block_bytes:
            used, block = 0, block + 1
        placed.append((lang, shard, starts[lang], block))
        starts[lang] += n
        used += size
    where = spark.createDataFrame(placed, "lang string, shard int, start long, block int")
    rows = shards.join(where, ["lang", "shard"])
    slots = rows.select("lang", "start", F.posexplode("terms").alias("at", "term")).select("lang", (F.col("start") + F.col("at")).alias("slot"), F.col("term").cast("string").alias("term"))
    passes = []
    for b in range(block + 1) if placed else []:
        held = spark.sparkContext.broadcast(Block.of(rows.filter(F.col("block") == b).select("lang", "shard", "shards", "start", "levels", "terms").toArrow()))
        told = own.select("lang", "source", "text").mapInArrow(_recounted(held), "lang string, source string, slots array<long>, counts array<long>")
        each = told.select("lang", "source", F.explode(F.arrays_zip("slots", "counts")).alias("x")).groupBy("lang", "source", F.col("x.slots").alias("slot")).agg(F.sum("x.counts").alias("n"))
        passes.append(stored(each))
        held.destroy()
    counts = passes[0] if passes else spark.createDataFrame([], "lang string, source string, slot long, n long")
    for more in passes[1:]:
        counts = counts.unionByName(more)
    return counts, slots


def share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (count + 1) / total), by long division in base 1000: exact for totals below 9e15."""
    out, rest = np.zeros(np.broadcast(counts, total).shape, dtype=np.int64), counts + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _pair_sums(part: pd.DataFrame) -> pd.DataFrame:
    """Sums over the slots of one block, for all ordered pairs of the language's sources."""
    sources, width = part["source"].tolist(), int(part["width"].iat[0])
    counts = np.zeros((len(sources), width), dtype=np.int64)
    for row, entries in zip(counts, part["entries"], strict=True):
        if entries is not None and len(entries):
            row[[e["at"] for e in entries]] = [e["n"] for e in entries]
    p = share(counts, part["total"].to_numpy(dtype=np.int64)[:, None])
    out = [pd.DataFrame({"source": s, "item": sources, "value": ((p[i] - p) ** 2 // p).sum(axis=1)}).drop(index=i) for i, s in enumerate(sources)]
    told = pd.concat(out, ignore_index=True)
    return told.assign(lang=part["lang"].iat[0])[["lang", "source", "item", "value"]]


def divergences(docs: DataFrame, least: int = MIN_DOCUMENTS, shard_keys: int = SHARD_KEYS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank of every source of every language (see the contract of op11).

    Null text, lang and source are ''. A row is a document, so repeated rows count each. Other columns do not matter, and an empty
    table gives no rows. Exact: counts are integers, p comes from long division, f from integer division (below 2**63, as p is
    at most 1e9 + 1)."""
    own = _own(docs)
    vocabulary = stored(kept_terms(own, least))
    shards = stored(perfect_hashes(vocabulary, shard_keys))
    counts, slots = recount(own, shards, block_bytes)
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kinds = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kinds, "lang", "left").fillna(0, ["total", "terms"])
    # A group's p has total + terms below the line; the language's has the sum of its groups' totals.
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.count("*").alias("sources"))
    groups = stored(groups.join(of_lang, "lang"))

    # Pairs: the slots of a language in blocks; each holds a row of every source, so its arrays have at most about a million counts.
    most = groups.agg(F.coalesce(F.max("sources"), F.lit(1))).first()[0]
    size = int(np.clip((1 << 20) // most, 16, 4096))
    entries = counts.withColumn("block", F.floor(F.col("slot") / size)).groupBy("lang", "source", "block").agg(F.collect_list(F.struct((F.col("slot") % size).cast("int").alias("at"), "n")).alias("entries"))
    blocks = groups.filter("terms > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("terms") - 1) / size))))
    width = F.least(F.lit(size), F.col("terms") - F.col("block") * size)
    full = blocks.select("lang", "source", "block", (F.col("total") + F.col("terms")).alias("total"), width.alias("width")).join(entries, ["lang", "source", "block"], "left")
    told = full.groupBy("lang", "block").applyInPandas(_pair_sums, "lang string, source string, item string, value long")
    bare = groups.filter("terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = told.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(none)

    # Terms: each with all its sources' counts (one entry a source), so that the language's count is at hand.
    by_slot = counts.groupBy("lang", "slot").agg(F.collect_list(F.struct("source", "n")).alias("each"), F.sum("n").alias("n_lang")).join(slots, ["lang", "slot"])
    rows = by_slot.select("lang", "term", "n_lang", F.explode("each").alias("x")).select("lang", "term", "n_lang", "x.source", "x.n")
    of_group = groups.select("lang", "source", "total", "terms", "all")
    rows = rows.join(F.broadcast(of_group) if groups.count() <= BROADCAST_GROUPS else of_group, ["lang", "source"])
    p = lambda n, total: F.expr(f"1 + CAST({n} + 1 AS DECIMAL(20, 0)) * {SCALE}BD div CAST({total} + terms AS DECIMAL(20, 0))")
    rows = rows.withColumns({"p": p("n", "total"), "q": p("n_lang", "all")}).filter("p > q")
    terms = rows.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    def ranked(df: DataFrame, part: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= RANKS))


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT + any_value(coalesce(v, 0)) AS total FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v ON v.lang = g.lang GROUP BY 1, 2),
l AS (SELECT lang, sum(n)::HUGEINT + any_value(v) AS total FROM c JOIN v USING (lang) GROUP BY 1),
gp AS (SELECT s.lang, s.source, term, coalesce(n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + 1)) // total AS p FROM s JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
lp AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n)::HUGEINT + 1)) // any_value(total) AS q FROM c JOIN l USING (lang) GROUP BY 1, 2),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
terms AS (SELECT gp.lang, gp.source, term AS item, ((p - q) * (p - q)) // q AS value FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= {RANKS}"""
