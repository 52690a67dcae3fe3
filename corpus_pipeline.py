"""From raw documents to token ids in five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import common, mixing, nearcopies, pieces, quality, suffixes

#: Rows of 8 bytes up to which the documents to drop are sent to all tasks instead of being joined by a shuffle.
SEND_ROWS = 1_000_000
#: Words of the shortest passage that may not repeat: over 50.
PASSAGE_WORDS = 51


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), payload=True)
    return scored.where("predicted = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of those with the least id, of each group of near copies. Texts without words are in no group."""
    found = nearcopies.near_copies(docs).groupBy("row_key").agg(F.min("first").alias("first"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"))
    found = common.materialize(found.where("not first or (n > 1 and n_shingles > 0)").select("row_key", "first"), "gone", narrow=True)
    n_again, n_gone = found.agg(F.count_if("first"), F.count_if(~F.col("first"))).first()
    send = lambda keys, n: F.broadcast(keys) if n <= SEND_ROWS else keys
    is_key = F.xxhash64("doc_id", "text") == F.col("row_key")
    left = docs.join(send(found.where("not first").select("row_key"), n_gone), is_key, "left_anti")
    if not n_again:
        return left
    # rows that repeat: one of each id and text
    again = send(found.where("first").select("row_key"), n_again)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(again, is_key, "left_semi").select(F.xxhash64("doc_id", "text").alias("row_key"), row.alias("row")).groupBy("row_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return left.join(again, is_key, "left_anti").select(*docs.columns).union(one.select("row.*"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; those of which no word is left go."""
    left = suffixes.deduplicate(docs, length=PASSAGE_WORDS, words=True, payload=True).select("kept", "n_removed", "row.*")
    changed = F.col("n_removed") > 0
    columns = [F.col("kept").alias(c) if c == "text" else F.when(changed, F.length("kept").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return left.where(~changed | (common.n_words("kept") > 0)).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, in the order of the mix: a row for each pass over a document, whose text is cut where the pass ends. Documents that no pass takes from go."""
    taken = F.explode(F.arrays_zip(F.col("passes").alias("words"), F.col("places").alias("slot"))).alias("pass")
    mixed = mixing.mix(docs, payload=True).select("size", "row", "n_slots", taken).select("size", "row", "n_slots", "pass.*").where("words > 0")
    # slots hold equally many words, and so do ranges of them
    tasks = common.parts(spark)
    mixed = mixed.repartitionById(tasks, F.expr(f"cast(slot * {tasks} div n_slots as int)")).sortWithinPartitions("slot", F.xxhash64("row"))
    text = F.when(F.col("words") < F.col("size"), F.expr(r"array_join(slice(filter(split(row.text, '[\\x20\\x09-\\x0D]+'), w -> w != ''), 1, cast(words as int)), ' ')")).otherwise(F.col("row.text"))
    cut = F.col("words") < F.col("size")
    mixed = mixed.withColumn("text", text).select("text", cut.alias("cut"), "row")
    columns = [F.col("text") if c == "text" else F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return mixed.select(*columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_passages),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", to_pieces),
]

#: SQL can't express the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
