"""Reports of users as an append-only log of versions: saving and resolving are idempotent upserts, a notice goes out once, and old versions are compacted.

Below a path, log/at=<version> has the rows of one write, snapshot/upto=<version> the newest rows of all writes up to one, outbox/at=<version> the notices, and
attachments/<id>.zip the files that a user chose to send. A write whose version is written again replaces itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import zips

REPORT = "id string, endpoint string, error string, notify string, attached array<string>, saved_at string, resolved_at string, resolution string"
NOTICE = "id string, address string, resolution string"
COLUMNS = [c.split()[0] for c in REPORT.split(", ")]
# Fixed value: characters of a resolution that are kept.
RESOLUTION_CHARS = 2000


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table in path, or none of its rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """REPORT and at, the version: the rows of the newest snapshot and of the writes after it."""
    snapshots = _read(spark, f"{path}/snapshot", REPORT + ", at long, upto long")
    upto = snapshots.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]
    return snapshots.where(F.col("upto") == upto).drop("upto").unionByName(_read(spark, f"{path}/log", REPORT + ", at long").where(F.col("at") > upto))


def current(spark: SparkSession, path: str) -> DataFrame:
    """REPORT: of each report the newest version; open ones first, then by id."""
    newest = versions(spark, path).groupBy("id").agg(F.max_by(F.struct(*COLUMNS[1:]), "at").alias("r")).select("id", "r.*")
    return newest.orderBy(F.col("resolved_at").isNotNull(), "id")


def next_version(spark: SparkSession, path: str) -> int:
    return int(versions(spark, path).agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]) + 1


def report_id(at_ts: Column, request: Column) -> Column:
    """The time, and six digits of the request's digest: a request that is saved again has the same id."""
    return F.concat(F.date_format(at_ts, "yyyyMMdd-HHmmss"), F.lit("-"), F.left(F.sha2(request.cast("string"), 256), F.lit(6)))


def save(requests: DataFrame, path: str, version: int, files: DataFrame | None = None) -> DataFrame:
    """requests: request, at_ts, endpoint, error, notify. files: request, position, name, content; they are kept under names that tell their place and kind only.

    Returns request and id. What could name a file is gone from the error; an address that is empty is none.
    """
    spark = requests.sparkSession
    own = requests.select("request", report_id(F.col("at_ts"), F.col("request")).alias("id"), "endpoint", tx.scrubbed("error").alias("error"), F.nullif("notify", F.lit("")).alias("notify"), tx.iso_utc("at_ts").alias("saved_at"))
    attached = None
    if files is not None:
        extension = F.coalesce(F.nullif(F.regexp_extract(F.substring_index("name", "/", -1), r"^.+(\.[^.]*)$", 1), F.lit("")), F.lit(".epub"))
        nth = F.expr("row_number() over (partition by id order by position)")
        named = files.join(own.select("request", "id"), "request").withColumn("position", nth).select("id", "position", "content", F.concat(F.lit("input-"), F.col("position").cast("string"), extension).alias("name"))
        zips.write(named.select(F.concat("id", F.lit(".zip")).alias("archive"), "position", "name", "content", F.lit(True).alias("stored")), f"{path}/attachments")
        attached = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("attached"))
    rows = own.join(attached, "id", "left") if attached is not None else own.withColumn("attached", F.lit(None).cast("array<string>"))
    rows = rows.withColumn("attached", F.coalesce("attached", F.array().cast("array<string>"))).withColumn("resolved_at", F.lit(None).cast("string")).withColumn("resolution", F.lit(None).cast("string"))
    rows.select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/log/at={version}")
    return _read(spark, f"{path}/log/at={version}", REPORT).join(own.select("request", "id"), "id").select("request", "id")


def resolve(asked: DataFrame, path: str, version: int, now: Column | None = None) -> DataFrame:
    """asked: id, resolution. Closes reports; who left an address and wasn't told yet is, through the outbox, and the address is not kept.

    Returns id, status (resolved, or unknown_id), notified. A report that is closed again has its new resolution, and no one is told twice, also when the same
    version is written again: what was known before it decides.
    """
    spark = asked.sparkSession
    before = versions(spark, path).where(F.col("at") < version).groupBy("id").agg(F.max_by(F.struct(*COLUMNS[1:]), "at").alias("r")).select("id", "r.*")
    stamp = tx.iso_utc(now if now is not None else F.current_timestamp())
    one = asked.groupBy("id").agg(F.max("resolution").alias("told"))
    known = before.join(one, "id").withColumn("address", F.col("notify"))
    closed = known.withColumn("resolved_at", stamp).withColumn("resolution", F.left("told", F.lit(RESOLUTION_CHARS))).withColumn("notify", F.lit(None).cast("string"))
    known.where("address is not null").select("id", "address", F.left("told", F.lit(RESOLUTION_CHARS)).alias("resolution")).write.mode("overwrite").parquet(f"{path}/outbox/at={version}")
    closed.select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/log/at={version}")
    done, told = _read(spark, f"{path}/log/at={version}", REPORT).select("id"), _read(spark, f"{path}/outbox/at={version}", NOTICE).select("id")
    out = one.select("id").join(done.withColumn("known", F.lit(True)), "id", "left").join(told.withColumn("told", F.lit(True)), "id", "left")
    return out.select("id", F.when(F.col("known"), "resolved").otherwise("unknown_id").alias("status"), F.coalesce("told", F.lit(False)).alias("notified"))


def outbox(spark: SparkSession, path: str) -> DataFrame:
    """NOTICE and at: whom to tell, once each; a sender remembers the last version it has sent."""
    return _read(spark, f"{path}/outbox", NOTICE + ", at long")


def compact(spark: SparkSession, path: str) -> int:
    """Writes the newest versions as a snapshot, which readers use from then on, and returns the version up to which it holds. Addresses of closed reports are in no snapshot."""
    upto = next_version(spark, path) - 1
    newest = versions(spark, path).groupBy("id").agg(F.max_by(F.struct(*COLUMNS[1:], "at"), "at").alias("r")).select("id", "r.*")
    newest.write.mode("overwrite").parquet(f"{path}/snapshot/upto={upto}")
    return upto
