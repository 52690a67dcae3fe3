"""The resumable map of a translation: a stream of exported blocks into a table of translated ones, in which a block is asked for once, whenever a run is stopped.

Each round of a micro-batch is kept before the next begins, in a folder named by the run and the round, and a round is what a stopped run can lose. A batch that is
run again asks only for what no folder has, so its appends add nothing twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import exchange

CACHE = "book string, i int, text string"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """CACHE: what was translated so far. Nothing where there is no such folder yet; a file that can't be read counts as empty, so its blocks are asked for again."""
    try:
        kept = spark.read.schema(CACHE + ", run string, batch long").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    # a block that two runs at once have asked for has two rows, of which the later batch's counts
    newest = F.max_by("text", F.struct("batch", "run", "text"))
    return kept.where("book is not null and i is not null").groupBy("book", "i").agg(newest.alias("text"))


def read_json_cache(files: DataFrame) -> DataFrame:
    """files: book, json, an object of texts by number. CACHE; of a file that is something else, nothing."""
    return files.select("book", F.explode(F.from_json("json", "map<string, string>")).alias("i", "text")).select("book", F.expr("try_cast(i as int)").alias("i"), "text").where("i is not null")


def json_cache(cache: DataFrame) -> DataFrame:
    """book, json: a cache as read_json_cache() takes it, a file for each book."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "text")))
    return cache.groupBy("book").agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["i"].cast("string"), x["text"])))).alias("json"))


def append(translated: DataFrame, path: str, run: str, batch: int) -> None:
    """Keeps what is done in a folder of its run and batch."""
    translated.where("status = 'done'").select("book", "i", "text").write.mode("append").parquet(f"{path}/run={run}/batch={batch}")


def resume(exported: DataFrame, provider: exchange.Provider, path: str, run: str = "table", rounds: int = 1, first: int = 0, **how) -> DataFrame:
    """Translates what the cache in path lacks, in rounds of which each is kept before the next begins, and returns the whole cache. how: as translate() takes it."""
    spark = exported.sparkSession
    for k in range(rounds):
        part = F.pmod(F.xxhash64("book", F.expr(f"i div {how.get('batch', exchange.BATCH)}")), F.lit(rounds)) == k
        append(exchange.translate(exported.where(part), provider, read_cache(spark, path), **how), path, run, first + k)
    return read_cache(spark, path)


def stream(exported: DataFrame, provider: exchange.Provider, path: str, checkpoint: str, run: str = "stream", rounds: int = 1, **how) -> StreamingQuery:
    """Starts to translate a stream of exported blocks into the cache in path, until what there is now is done. Start it again with the same checkpoint to go on.

    What a stopped run had kept isn't asked for again, also of the batch in which it stopped, of which rounds are kept one by one. Blocks that could not be translated
    stay out of the cache; resume() asks for them again.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            resume(rows, provider, path, run, rounds, batch * rounds, **how)
        finally:
            rows.unpersist()

    return exported.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
