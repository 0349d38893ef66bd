"""A corpus pipeline over documents: quality classifier, near-dedup, decontamination, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import decontam, packing, pii, quality, simhash
from stridelake.llm.common import fresh, stored, table
from stridelake.llm.queries import PII_KEY, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the documents labelled as good; what it does not draw goes. As many are drawn as are
    likelier under the model of good texts than under that of all texts."""
    target = quality.target_texts(docs, table(spark, sf_dir, "labels"))
    drawn = quality.resampled(docs, target)
    return drawn.filter(F.col(drawn.columns[-1])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest doc_id (nulls last), then by fingerprint and text hash.

    Rows are told apart by doc_id and text, so a group keeps its row whatever its ids: null, or shared with other groups.
    The keepers are joined always by a shuffle: they grow with the corpus, so they are never broadcast."""
    keepers = stored(simhash.keepers(docs)).withColumnRenamed("doc_id", "_id")
    (text_hash,) = fresh(docs, "_hash")
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))

    def kept(keys: DataFrame) -> DataFrame:
        same = hashed["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (hashed[text_hash] == keys["text_hash"])
        return hashed.join(keys.hint("merge"), same, "left_semi")

    if not keepers.filter("n > 1").limit(1).count():
        return kept(keepers).select(*docs.columns)
    repeated = kept(keepers.filter("n > 1")).dropDuplicates(["doc_id", text_hash])
    return kept(keepers.filter("n = 1")).unionByName(repeated).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any ten-word window of a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced, and n_chars follows the new text."""
    out = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no way to the classifier, the fingerprints and the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), instead_of=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
