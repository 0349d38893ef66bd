"""Importance resampling of raw text towards a target: hashed n-gram generative models and Gumbel top-k.

Two bag-of-hashed-n-grams models are counted, one over the target texts and one over all raw texts. A document's log weight is
the sum over its n-grams of the log ratio of the two models, scaled down to that of GRAMS n-grams where it has more: n-grams
of one text are far from independent, and unscaled a long text would have a weight of hundreds, against which the noise of
the draw is nothing. Adding Gumbel noise and taking the k greatest draws k documents without replacement in proportion to
exp(log weight). Features are uni- and bigrams of words and of word shapes (case, digits, symbols, repeat of the word
before), so that the models see form as well as vocabulary.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.llm.common import crc_fold, fresh, one_text, stored, with_field

BUCKETS = 1 << 14
#: Labelled documents that the target model is counted over, at most.
TARGET_ROWS = 20_000
#: n-grams that a document counts for at most.
GRAMS = 64
TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: Tokens of a text that are hashed at once.
BLOCK = 1 << 16


class Hasher:
    """Feature buckets of texts; codes of tokens seen before come from a bounded cache."""

    def __init__(self, buckets: int = BUCKETS, cached: int = 400_000):
        self.buckets, self.cached, self.codes = buckets, cached, {}

    def _code(self, token: str) -> int:
        """Hashes of the token in lower case (high half) and of its shape (low half)."""
        shape = "w" if token.islower() else "T" if token.istitle() else "U" if token.isupper() else "9" if token.isnumeric() else "x" if token[0].isalpha() else token
        digest = xxhash.xxh32_intdigest
        return digest(token.lower()) << 32 | digest("shape " + shape)

    def features(self, text: str | None) -> Iterator[np.ndarray]:
        """Buckets of the n-grams of a text, with repeats, in blocks; none for texts without tokens."""
        tokens = TOKENS.findall(text or "")
        if len(self.codes) > self.cached:
            self.codes.clear()
        codes = self.codes
        for at in range(0, len(tokens), BLOCK):
            part = tokens[max(0, at - 1) : at + BLOCK]
            for token in set(part):
                if token not in codes:
                    codes[token] = self._code(token)
            both = np.fromiter(map(codes.__getitem__, part), dtype=np.uint64, count=len(part))
            words, shapes = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
            same = np.zeros(len(part), dtype=np.uint64)
            same[1:] = words[1:] == words[:-1]
            shapes = shapes + same * np.uint64(0x9E3779B1)
            first = 1 if at else 0
            grams = [words[first:], shapes[first:], words[:-1] * np.uint64(0x85EBCA77) + words[1:], shapes[:-1] * np.uint64(0xC2B2AE3D) + shapes[1:] + np.uint64(7)]
            mixed = np.concatenate(grams)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            yield ((mixed >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)


def gram_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each bucket over all texts (column text): summed in each task first, so a row for each bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for part in hasher.features(text.as_py()):
                    total += np.bincount(part, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most `buckets` rows
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = BUCKETS) -> np.ndarray:
    """Of each bucket the log of its share in the target over that in the raw texts; 0 for buckets that the raw texts have not. The
    target's shares are drawn to the raw ones by `prior` counts, so that a small target says little, not the contrary."""
    seen = raw > 0
    share = raw[seen] / raw.sum()
    out = np.zeros(len(raw))
    out[seen] = np.log((target[seen] + prior * share) / (target.sum() + prior)) - np.log(share)
    return out


def weighted(docs: DataFrame, ratios: np.ndarray, grams: int = GRAMS, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if None) of docs with two more (double, long; log_weight and n_grams, with underscores where
    docs has these): the log weight and the number of n-grams. A text without tokens has log weight 0 of 0 n-grams."""
    keep = docs.columns if keep is None else keep
    held, text = docs.sparkSession.sparkContext.broadcast(ratios), docs.columns.index("text")
    places, names = [docs.columns.index(c) for c in keep], fresh(docs, "log_weight", "n_grams")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, hasher = held.value, Hasher(len(held.value))
        for batch in batches:
            sums, sizes = [], []
            for t in batch.column(text):
                parts = [(ratios[p].sum(), len(p)) for p in hasher.features(t.as_py())]
                n = sum(p[1] for p in parts)
                sums.append(float(sum(p[0] for p in parts)) * min(1.0, grams / max(n, 1)))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())], names=[*keep, *names])

    return docs.mapInArrow(score, with_field(T.StructType([docs.schema[i] for i in places]), (names[0], "double"), (names[1], "long")))


def gumbel(of: list[Column], seed: int | Column) -> Column:
    """Standard Gumbel noise that depends on the columns and the seed alone, so that a lost task draws the same again."""
    u = (F.shiftrightunsigned(F.xxhash64(*of, seed if isinstance(seed, Column) else F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_greatest(keys: DataFrame, k: int, digits: int = 16) -> int | None:
    """The k-th greatest value of the long column key, exactly: a histogram of at most 2**digits rows for each digit, from the top.
    None if k is 0; the least value if there are fewer than k."""
    if k <= 0:
        return None
    known, shift = 0, 64
    unsigned = keys.select(F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("key"))  # in the order of unsigned numbers
    while shift:
        shift -= digits
        same = F.lit(True) if shift + digits == 64 else F.shiftrightunsigned("key", shift + digits) == known
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << digits) - 1))
        rows = sorted(unsigned.filter(same).groupBy(digit.alias("d")).count().collect(), reverse=True)
        if not rows:
            return None
        for d, n in rows:
            chosen = d
            if k <= n:
                break
            k -= n
        else:
            k = rows[-1][1]
        known = known << digits | chosen
    out = known ^ (1 << 63)
    return out - (1 << 64) if out >> 63 else out


def sort_key(x: Column) -> Column:
    """The doubles x as longs in the same order, to six decimals."""
    return F.round(x * 1e6).cast("long")


def keyed(docs: DataFrame, target: DataFrame, seed: int = 0, grams: int = GRAMS, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if None) of docs, stored, with three more, named log_weight, n_grams and sample_key (with
    underscores where docs has these): sample_key is log weight + Gumbel noise, to six decimals.

    target: the texts to be like (column text); the raw model is counted over docs, whole. The noise depends on doc_id, text
    and seed: repeated rows share it. Texts without tokens have weight 1. An empty target says nothing (all weights are 1)."""
    raw, wanted = gram_counts(docs), gram_counts(target)
    ratios = log_ratios(wanted, raw)
    keep = docs.columns if keep is None else keep
    (noise,) = fresh(docs, "_noise")
    scored = weighted(docs.withColumn(noise, gumbel([F.col("doc_id"), F.col("text")], seed)), ratios, grams, [*keep, noise])
    weight, n = scored.columns[-2:]
    (key,) = fresh(docs, "sample_key")
    return stored(scored.select(*keep, weight, n, sort_key(F.col(weight) + F.col(noise)).alias(key)))


def drawn(keyed: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """keyed() with a last column for each (name, k) of sizes, underscores added if it is there: whether the row is among the k
    greatest sample keys. Ties with the k-th key are all selected, and repeated rows with each other."""
    key, names = keyed.columns[-1], fresh(keyed, *sizes)
    least = [kth_greatest(keyed.select(F.col(key).alias("key")), k) for k in sizes.values()]
    return keyed.select("*", *((F.lit(False) if at is None else F.col(key) >= at).alias(n) for n, at in zip(names, least, strict=True)))


def likelier(keyed: DataFrame) -> int:
    """How many rows are at least as likely under the target model as under the raw one."""
    return keyed.filter(F.col(keyed.columns[-3]) >= 0).count()


def resampled(docs: DataFrame, target: DataFrame, k: int | None = None, seed: int = 0, grams: int = GRAMS) -> DataFrame:
    """Every row of docs with the columns of keyed() and a last one, selected: whether it is among the k drawn. k None: as many
    as are likelier under the target model. Empty tables give an empty result."""
    held = keyed(docs, target, seed, grams)
    return drawn(held, {"selected": likelier(held) if k is None else k})


def target_texts(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """The texts of at most `rows` documents that are labelled as good, chosen by a hash of their ids; of an id with several
    texts the least. Ids whose crc32 modulo 5 is 0 are left for measuring."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").filter(crc_fold(F.col("doc_id")) != 0).select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return one_text(docs, chosen).select("text")
