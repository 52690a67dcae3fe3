"""Failure logs and reports: reading, digest, and the state of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

FAILURE = "at string, endpoint string, error_type string, error string, traceback string"
REPORT = "id string, endpoint string, error string, notify string, saved_at string, resolved_at string, resolution string"
# Characters kept of an error, the end of a traceback, a reason.
ERROR_CHARS, TRACEBACK_CHARS, REASON_CHARS = 800, 3000, 150


def read_failures(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """Lines of a JSON log with at_ts; blank and broken lines are left out. With since, so are earlier records and those whose time can't be read, which otherwise stay."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", FAILURE + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("x")).where("x is not null and x._broken is null").select("x.*").drop("_broken")
    parsed = parsed.withColumn("at_ts", F.try_to_timestamp("at"))
    return parsed.where(F.col("at_ts") >= since) if since is not None else parsed


def failure(events: DataFrame) -> DataFrame:
    """events (at_ts, endpoint, error_type, error, traceback) as log rows: names of files and long tails gone."""
    return events.select(
        tx.iso_utc("at_ts").alias("at"), "endpoint", "error_type", F.left(tx.scrubbed("error"), F.lit(ERROR_CHARS)).alias("error"), F.right(tx.scrubbed("traceback"), F.lit(TRACEBACK_CHARS)).alias("traceback")
    )


def append_failures(events: DataFrame, path: str) -> None:
    failure(events).write.mode("append").json(path)


def reasons(failures: DataFrame, order: str = "at") -> DataFrame:
    """reason, n, first: commonest first, ties by first seen. A reason is the whole error, scrubbed again; without one the error's type, and without that, unknown."""
    given = [F.nullif(F.col(c), F.lit("")) for c in ("error", "error_type") if c in failures.columns]
    of = failures.groupBy(tx.scrubbed(F.coalesce(*given, F.lit("unknown"))).alias("reason")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return of.orderBy(F.desc("n"), "first", "reason")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report.json below path; a report without an id is named by its folder."""
    own = spark.read.schema(REPORT).json(f"{path}/*/report.json", multiLine=True).withColumn("_path", F.col("_metadata.file_path"))
    return own.withColumn("id", F.coalesce("id", F.regexp_extract("_path", "([^/]+)/[^/]+$", 1))).drop("_path")


def latest(log: DataFrame, order: str = "saved_at") -> DataFrame:
    """The last row of each id of an append-only log of reports."""
    newest = W.partitionBy("id").orderBy(F.desc(order))
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def listed(reports: DataFrame) -> DataFrame:
    """Open reports first, then by id."""
    return reports.orderBy(F.col("resolved_at").isNotNull(), "id")


def resolve(reports: DataFrame, ids: list[str], note: str, now: Column | None = None) -> DataFrame:
    """Rows to append for the reports resolved: stamped, with the note, and to_notify, the address if it is the first time; the address is not kept."""
    stamp = tx.iso_utc(now if now is not None else F.current_timestamp())
    own = reports.where(F.col("id").isin(ids))
    first = F.col("resolved_at").isNull()
    return own.withColumn("to_notify", F.when(first, F.col("notify"))).withColumn("resolved_at", stamp).withColumn("resolution", F.left(F.lit(note), F.lit(2000))).withColumn("notify", F.lit(None).cast("string"))


def digest(failures: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: failures, by_reason (reasons as a reader sees them, cut), reports_open, reports_awaiting_reply, idle (nothing to tell)."""
    by = reasons(failures).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "reason"))).alias("r"))
    by = by.select("failures", F.transform("r", lambda x: F.struct(F.left(x["reason"], F.lit(REASON_CHARS)).alias("reason"), (-x["k"]).alias("n"))).alias("by_reason"))
    open_ = F.col("resolved_at").isNull()
    of = reports.agg(F.count_if(open_).alias("reports_open"), F.count_if(open_ & F.col("notify").isNotNull()).alias("reports_awaiting_reply"))
    return by.crossJoin(of).withColumn("idle", (F.col("failures") == 0) & (F.col("reports_open") == 0))  # one row each


def killed(starts: DataFrame, finishes: DataFrame, longest: str | None = None) -> DataFrame:
    """starts, finishes: job, at_ts. Jobs that began and never ended, or not within `longest`, as failures at the time at which they began."""
    begun, ended = starts.alias("begun"), finishes.alias("ended")
    same = F.col("begun.job") == F.col("ended.job")
    return _as_killed(begun.join(ended, same & _within(longest) if longest else same, "left_anti"))


def killed_stream(starts: DataFrame, finishes: DataFrame, longest: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same over two streams: a start is a failure when the watermark says that no finish within `longest` can come any more. State holds what may still meet."""
    begun, ended = starts.withWatermark("at_ts", late).alias("begun"), finishes.withWatermark("at_ts", late).alias("ended")
    both = begun.join(ended, (F.col("begun.job") == F.col("ended.job")) & _within(longest), "left_outer")
    return _as_killed(both.where("ended.job is null").select("begun.*"))


def _within(longest: str) -> Column:
    return F.expr(f"ended.at_ts between begun.at_ts and begun.at_ts + interval {longest}")


def _as_killed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("error_type", F.lit("Killed")).withColumn("error", F.lit("The job began and never ended; the process was probably stopped from outside."))
