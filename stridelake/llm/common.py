"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of the operators' contracts: ASCII white space only.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, as in tests, one of this
    machine serves if all tasks run on it too; else this fails."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="stridelake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Where stored tables lie, as long as their frames are in use.
_FILES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, outlives executors, and is computed once however often it is used.

    The files stay until the folder is cleaned, since later (lazy) reads need them; those of `instead_of`, a stored frame that
    nothing reads any more once df is written, are deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stridelake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FILES[out] = path
    if instead_of is not None and (old := _FILES.pop(instead_of, None)):
        where = spark._jvm.org.apache.hadoop.fs.Path(old)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no such column (names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_field(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """schema with more fields, given by name and DDL type."""
    out = T.StructType(list(schema.fields))
    for name, kind in fields:
        out = out.add(name, T._parse_datatype_string(kind))
    return out


def one_text(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (distinct doc_ids of a bounded number, more columns) with the text of each: the least of an id's texts, so that
    repeated ids give no more rows. Ids that docs has not are left out."""
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def crc_fold(column, folds: int = 5):
    """crc32 of the column as text, modulo folds."""
    return F.crc32(column.cast("string").cast("binary")) % folds
