"""Readers and sinks of tables: optional sources, upserts, incremental reads, schema enforcement."""

from __future__ import annotations

import csv
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a record stream that meet in one task, about.
TASK_ROWS = 100_000
#: Over how many partitions a session's record streams are dealt.
PARTS = "spark.stridelake.partitions"


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys over as many partitions as leave about `rows` rows to each (a key's rows stay together), whatever
    spark.sql.shuffle.partitions is: so what a task sorts and holds does not grow with the table. df should be a table as it is read, whose
    rows the footers of its files tell. The number is kept in the session's PARTS, for dealt_again()."""
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, df.count() // rows + 1)
    spark.conf.set(PARTS, str(parts))
    return df.repartition(parts, *keys)


def dealt_again(df: DataFrame, *keys: str) -> DataFrame:
    """df, a union over a table that dealt() gave (which loses how that lies), dealt by keys over as many partitions."""
    parts = df.sparkSession.conf.get(PARTS, None)
    return df.repartition(int(parts), *keys) if parts else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, as in tests, one of this
    machine serves if all tasks run on it too; else this fails."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="stridelake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Where stored tables lie, as long as their frames are in use.
_FILES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, outlives executors, is computed once however often it is used.

    The files stay until the folder is cleaned, since lazy reads need them; those of `instead_of`, a stored frame that nothing reads
    any more once df is written, are deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stridelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FILES[out] = path
    if instead_of is not None and (old := _FILES.pop(instead_of, None)):
        where = spark._jvm.org.apache.hadoop.fs.Path(old)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out


def optional(spark: SparkSession, path: str, schema: T.StructType, required: bool = False) -> DataFrame:
    """The table at path, or an empty one of the schema where there is none and it is not required."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], schema)


def enforced(df: DataFrame, schema: T.StructType) -> DataFrame:
    """P10: the columns of the schema in its order; missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the first by order (which should be total)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, those of new in place of old ones with its keys; of repeated new rows one by all columns in order."""
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    order = [F.col(c).desc_nulls_last() for c in new.columns if c not in key] or [F.lit(0)]
    return union_all(kept, latest(new, key, order))


def unseen(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not known yet."""
    return rows.join(known.select(*key).distinct(), key, "left_anti")


def changed_files(files: DataFrame, cache: DataFrame, version: int, tolerance_s: float = 1.0) -> DataFrame:
    """The files (path, mtime) whose cached metadata (path, mtime, version) cannot be reused: no entry of this version has the
    path and a time at most tolerance_s away. Rows with a null path or time count as changed. The join is on the path."""
    valid = cache.filter(F.col("version") == version).select("path", F.col("mtime").alias("_cached"))
    apart = F.abs(F.col("mtime").cast("double") - F.col("_cached").cast("double"))
    same = files.select("path", "mtime").join(valid, "path").filter(apart <= tolerance_s).select("path", "mtime").distinct()
    return files.join(same, ["path", "mtime"], "left_anti").select(*files.columns)


def clean_name(name: str) -> str:
    """A column's name without quotes and blanks around it."""
    return name.strip().strip('"').strip()


def trimmed_header(df: DataFrame) -> DataFrame:
    """Df with clean names."""
    return df.toDF(*map(clean_name, df.columns))


def export_by(df: DataFrame, path: str, *columns: str) -> None:
    """One folder for each value of the columns; rows are brought together first, so that a folder has few files."""
    df.repartition(*columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def append(df: DataFrame, path: str, *columns: str) -> None:
    """S9."""
    writer = df.write.mode("append")
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def find_column(df: DataFrame, keyword: str) -> str | None:
    """The first column whose name contains the keyword, without case."""
    return next((c for c in df.columns if keyword.lower() in c.lower()), None)


def first_existing(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of the candidates that df has as a column."""
    return next((c for c in candidates if c in df.columns), None)


def rearranged(df: DataFrame, drop: list[str] | None = None, rename: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """Df without the columns `drop`, others renamed, and each column of `after` put behind the one it maps to. Names that df
    has not say nothing."""
    names = [c for c in df.columns if c not in (drop or [])]
    out = df.select(*names).withColumnsRenamed(rename or {})
    order = list(out.columns)
    for column, place in (after or {}).items():
        if column in order and place in order and column != place:
            order.remove(column)
            order.insert(order.index(place) + 1, column)
    return out.select(*order)


def enriched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left with the columns of right that it has not, by equal keys. The number of rows never changes: right must have each key
    once, else this fails."""
    twice = right.groupBy(*on).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"right has a key more than once: {twice[0].asDict()}")
    return left.join(right.select(*on, *(c for c in right.columns if c not in left.columns)), on, "left")


def missing_files(expected: DataFrame, landed: DataFrame, key: str, since) -> DataFrame:
    """Expected rows (key, date) from a date on of which no file has landed."""
    return expected.filter(F.col("date") >= F.lit(since)).join(landed.select(key).distinct(), key, "left_anti")


def write_mart(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> DataFrame:
    """Df, its columns rounded half to even to the digits given, written over what is at path; and read again."""
    rounded = [F.bround(F.round(c, 9), digits[c]).alias(c) if c in (digits or {}) else F.col(c) for c in df.columns]
    df.select(*rounded).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_daily(texts: DataFrame, schema: T.StructType) -> DataFrame:
    """S3: a daily table of texts with the types of the schema (which has a date): a date is the first ten characters, values that cannot
    be read are null, missing columns too, other columns go. Rows without a date that can be read are left out."""
    have = set(texts.columns)

    def typed(f: T.StructField):
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        text = F.trim(F.col(f.name).cast("string"))
        return (F.substring(text, 1, 10) if f.name == "date" else text).try_cast(f.dataType).alias(f.name)

    return texts.select(*map(typed, schema.fields)).filter("date IS NOT NULL")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Key, value of a JSON object of texts (a small file, such as a cache of addresses), read whole."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>"))).select("key", "value")


#: Layouts (distinct header lines) that one landing folder may have.
MOST_LAYOUTS = 200


def read_csvs(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.csv", corrupt: str = "corrupt") -> DataFrame:
    """All CSV files below path whose name matches the pattern, each by its own header: names lose quotes and blanks, columns are
    taken by name in any order, missing ones are null and others go; values that cannot be read as their type are null. A line
    with more or fewer cells than its header has is a row of nulls with the line in `corrupt`. Lines end records (no line breaks in
    cells). Headers are read first, a line a file; of them only the distinct ones come to the driver."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    lines = lines.select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    heads = lines.filter("_block = 0").withColumn("_at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "_at").alias("head"))
    heads = stored(heads)
    layouts = [r["head"] for r in heads.select("head").distinct().limit(MOST_LAYOUTS + 1).collect()]
    if len(layouts) > MOST_LAYOUTS:
        raise ValueError(f"over {MOST_LAYOUTS} different headers below {path}")
    rows = lines.join(heads, "file").filter((F.col("value") != F.col("head")) & (F.trim("value") != ""))
    parts = [enforced(spark.createDataFrame([], schema), schema).withColumn(corrupt, F.lit(None).cast("string"))]
    for head in layouts:
        names = [clean_name(c) for c in next(csv.reader([head]))]
        cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("_bad", T.StringType())])
        own = rows.filter(F.col("head") == head).select(F.from_csv("value", cells.simpleString()[len("struct<") : -1].replace(":", " "), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("x"))
        at = {n: F.when(F.col("x._bad").isNull(), F.trim(F.col(f"x.c{i}"))) for i, n in enumerate(names)}
        parts.append(own.select(*((at[f.name].try_cast(f.dataType) if f.name in at else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields), F.col("x._bad").alias(corrupt)))
    return union_all(*parts)


def file_states(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Path, mtime and size of all files below path, from the hidden columns that every file source has; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"))


#: What identifies a row of a landed table: the first of these that it has.
KEYS = ("activity_id", "timestamp", "date")


def upsert_key(df: DataFrame) -> str:
    """The first of activity_id, timestamp and date that df has."""
    found = first_existing(df, list(KEYS))
    if found is None:
        raise ValueError(f"none of {KEYS} among {df.columns}")
    return found


def upsert_partitions(new: DataFrame, path: str, partition: str, key: list[str] | None = None) -> DataFrame:
    """The rows of new put into the partitioned table at path, which is read again. Only partitions that new touches are read
    and written (dynamic overwrite); the files of others stay. A key must stay in its partition. key: upsert_key() by default.
    The merged partitions are stored first, so that a job that fails in between has overwritten nothing."""
    key = key or [upsert_key(new)]
    old = new.sparkSession.read.parquet(path)
    touched = stored(new.select(partition).distinct())
    same = old.schema[partition].dataType
    merged = stored(upserted(old.join(touched.withColumn(partition, F.col(partition).cast(same)), partition, "left_semi").select(*old.columns), new.select(*(F.col(c).cast(old.schema[c].dataType).alias(c) for c in old.columns)), key))
    merged.repartition(partition).sortWithinPartitions(partition, *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return new.sparkSession.read.parquet(path)
