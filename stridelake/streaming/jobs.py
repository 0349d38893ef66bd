"""Streaming forms of the batch operators, for Structured Streaming. Events: user_id, ts (timestamp), value, event_type."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stridelake.sources.tables import latest as latest_rows


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """ST1: files of a folder, or one table (a file, or a folder of part files), as a stream with the schema of what is there."""
    found = spark.read.parquet(path)
    stream = spark.readStream.schema(found.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if not name.endswith(".parquet"):
        return stream.option("pathGlobFilter", "*.parquet").parquet(path)
    if any(f"/{name}/" in file for file in found.inputFiles()):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", name).parquet(folder)


def unseen(events: DataFrame, key: str, delay: str = "3 days") -> DataFrame:
    """ST1: each key once within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def daily_load(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """ST3: sum and count of each athlete and day; rows over three days late are dropped."""
    days = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum("value").alias("load"), F.count("*").alias("n"))
    return days.select("user_id", F.to_date("window.start").alias("date"), "load", "n")


def acute_load(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """ST6: seven-day sums that slide by a day."""
    weeks = events.withWatermark("ts", delay).groupBy(F.window("ts", "7 days", "1 day"), "user_id").agg(F.sum("value").alias("load"))
    return weeks.select("user_id", F.to_date("window.end").alias("until"), "load")


def inactivity_sessions(events: DataFrame, gap: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """ST5: sessions of rows that lie within `gap` of each other."""
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")


FITNESS = "user_id long, date date, ctl double, atl double, tsb double"


def fitness(events: DataFrame, ctl_days: float = 42, atl_days: float = 7) -> DataFrame:
    """ST4: fitness and fatigue carried from day to day in state; the sums of a batch's days are taken up in order, days between
    them decay with no load. For daily sums, which no batch splits; of single rows see closed_fitness()."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ctl, atl, last = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(frames)).groupby("date")["load"].sum().sort_index()
        out = []
        for date, load in rows.items():
            day = pd.Timestamp(date).toordinal()
            if ctl is None:
                ctl = atl = float(load)
                before = None
            else:
                idle = max(0, day - last - 1)
                ctl, atl = ctl * (1 - 1 / ctl_days) ** idle, atl * (1 - 1 / atl_days) ** idle
                before = ctl
                ctl, atl = ctl + (load - ctl) / ctl_days, atl + (load - atl) / atl_days
            last = day
            out.append((key[0], date, ctl, atl, None if before is None else before - atl))
        state.update((ctl, atl, last))
        yield pd.DataFrame(out, columns=["user_id", "date", "ctl", "atl", "tsb"])

    return events.groupBy("user_id").applyInPandasWithState(step, FITNESS, "ctl double, atl double, last long", "append", GroupStateTimeout.NoTimeout)


#: Athletes (by neighbouring ids) whose averages lie in one group of state.
GROUP_USERS = 100


class _ClosedDays(StatefulProcessor):
    """Averages of a group of athletes up to the last closed day of each, as one list, which a batch's closed days read and write once."""

    def __init__(self, ctl_days: float, atl_days: float) -> None:
        self.ctl_days, self.atl_days = ctl_days, atl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "user_id long, ctl double, atl double, day long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = {user: (ctl, atl, day) for user, ctl, atl, day in self.known.get()}
        days = pd.concat(list(rows)).sort_values(["user_id", "day"])
        out = []
        for user, day, load in zip(days["user_id"].tolist(), days["day"].tolist(), days["load"].tolist(), strict=True):
            before = None
            if user in last:
                ctl, atl, then = last[user]
                idle = max(0, day - then - 1)
                before, atl = ctl * (1 - 1 / self.ctl_days) ** idle, atl * (1 - 1 / self.atl_days) ** idle
                ctl, atl = before + (load - before) / self.ctl_days, atl + (load - atl) / self.atl_days
            else:
                ctl = atl = load
            last[user] = (ctl, atl, day)
            out.append((user, dt.date(1970, 1, 1) + dt.timedelta(days=day), ctl, atl, None if before is None else before - atl))
        self.known.put([(user, *x) for user, x in last.items()])
        yield pd.DataFrame(out, columns=["user_id", "date", "ctl", "atl", "tsb"])

    def close(self) -> None:
        pass


def closed_fitness(events: DataFrame, delay: str = "3 days", ctl_days: float = 42, atl_days: float = 7) -> DataFrame:
    """ST4 over single rows (user_id, ts, load): a day adds up in state over as many batches and runs as its rows take, and is closed
    once the watermark has passed its end (UTC); its averages then follow from those of the day closed before. Rows of closed days
    are dropped. Days add up in a streaming aggregation; only what it closes goes on to Python, some athletes at a time, so that
    state is asked once for a group and not some times for each day. Needs the state store RocksDB (see rocks())."""
    days = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum("load").alias("load"))
    rows = days.select("user_id", F.floor(F.unix_seconds("window.start") / 86400).alias("day"), F.coalesce("load", F.lit(0.0)).alias("load"), F.floor(F.col("user_id") / GROUP_USERS).alias("group"))
    return rows.groupBy("group").transformWithStateInPandas(_ClosedDays(ctl_days, atl_days), FITNESS, "Append", "None")


def rocks(spark: SparkSession) -> None:
    """Streams of this session that start from now on keep their state in RocksDB, on disk with checkpoints, not in the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def upsert_sink(path: str, key: list[str], first: int = 0) -> Callable[[DataFrame, int], None]:
    """ST2: a foreachBatch function that lays each batch, one row for each key, beside the others, numbered from `first` on: what it
    writes grows with the batch, not with the table, and a repeated batch writes over itself. latest() puts the rows of greater
    numbers in place of others."""

    def write(batch: DataFrame, number: int) -> None:
        order = [F.col(c).desc_nulls_last() for c in batch.columns if c not in key] or [F.lit(0)]
        latest_rows(batch, key, order).write.mode("overwrite").parquet(f"{path}/v={first + number}")

    return write


def latest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """ST2: one row for each key: that of the batch with the greatest number."""
    rows = spark.read.parquet(path)
    return latest_rows(rows, key, [F.desc("v")]).select(*(c for c in rows.columns if c != "v"))


def compacted(spark: SparkSession, path: str, to: str, key: list[str]) -> None:
    """ST2: the state of latest() as the first batch of a new table, when there are many batches."""
    latest(spark, path, key).write.mode("overwrite").parquet(f"{to}/v=0")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and not yet taken, into Parquet (append) or, in complete mode, a table of the last state. Another
    run over the same folder goes on from its checkpoint: what has landed since is added."""
    spark = stream.sparkSession
    out, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(out)
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
