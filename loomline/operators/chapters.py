"""Chapters of aligned or single block sequences, and their statistics: windows and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def level(blocks: DataFrame, key: str) -> DataFrame:
    """key, level: the most major heading level with more than one heading, else the most major present; null without headings. Both sides' blocks count."""
    counts = blocks.groupBy(key, tx.heading_level("tag").alias("hlevel")).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("n") > 1, F.col("hlevel"))), F.min("hlevel")).alias("level"))


def cut(units: DataFrame, key: str, order: str, is_cut: str = "is_cut") -> DataFrame:
    """units with chapter, from 1: a new one at each cut; what comes before the first cut is one of its own."""
    running = W.partitionBy(key).orderBy(order)
    counted = units.withColumn("_cuts", F.sum(F.col(is_cut).cast("int")).over(running.rowsBetween(W.unboundedPreceding, 0)))
    return counted.withColumn("chapter", F.dense_rank().over(W.partitionBy(key).orderBy("_cuts"))).drop("_cuts")


def of_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, seq, tag, frag) with level, is_cut and chapter."""
    own = blocks.join(level(blocks, key), key, "left").withColumn("is_cut", F.coalesce(tx.heading_level("tag") == F.col("level"), F.lit(False)))
    return cut(own, key, "seq")


def titles(blocks: DataFrame, key: str) -> DataFrame:
    """key, chapter, title, first, blocks: of chapters made by of_blocks(); the title is that of the block that began it, null for what comes before the first."""
    return blocks.groupBy(key, "chapter").agg(F.min_by(F.when(F.col("is_cut"), tx.title_text("frag")), "seq").alias("title"), F.min("seq").alias("first"), F.count("*").alias("blocks"))


def of_beads(beads: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """beads (pair_id, bead, a_from, a_n, b_from, b_n) with level, is_cut, title_a, title_b (null unless the bead cuts) and chapter. A bead cuts where a block of either side has the level."""
    both = a.select("pair_id", "tag").unionByName(b.select("pair_id", "tag"))
    levels = level(both, "pair_id")
    out = beads.where(F.col("bead").isNotNull()).join(levels, "pair_id", "left")
    for side, blocks in (("a", a), ("b", b)):
        of = beads.where(F.col("bead").isNotNull()).select("pair_id", "bead", F.explode(F.when(F.col(f"{side}_n") > 0, F.sequence(F.col(f"{side}_from"), F.expr(f"{side}_from + {side}_n - 1")))).alias("seq"))
        heads = of.join(blocks.select("pair_id", F.col("seq").cast("int").alias("seq"), tx.heading_level("tag").alias("hlevel"), "frag"), ["pair_id", "seq"]).join(levels, "pair_id").where(F.col("hlevel") == F.col("level"))
        out = out.join(heads.groupBy("pair_id", "bead").agg(F.min_by("frag", "seq").alias(f"title_{side}")), ["pair_id", "bead"], "left")
    return cut(out.withColumn("is_cut", F.col("title_a").isNotNull() | F.col("title_b").isNotNull()), "pair_id", "bead")


def statistics(beads: DataFrame, *keys: str) -> DataFrame:
    """Counts per group of beads: blocks of each side, 1:1, other pairings, one-sided ones, and doubtful ones if that is known."""
    paired, both = (F.col("a_n") > 0) & (F.col("b_n") > 0), (F.col("a_n") == 1) & (F.col("b_n") == 1)
    unsure = F.count_if("doubtful") if "doubtful" in beads.columns else F.lit(0)
    return beads.where(F.col("bead").isNotNull()).groupBy(*keys).agg(
        F.sum("a_n").alias("a"), F.sum("b_n").alias("b"), F.count_if(both).alias("n11"), F.count_if(paired & ~both).alias("nxx"),
        F.count_if((F.col("a_n") > 0) & (F.col("b_n") == 0)).alias("a_only"), F.count_if((F.col("a_n") == 0) & (F.col("b_n") > 0)).alias("b_only"), unsure.cast("long").alias("unsure"),
    )


def clean_ratio(stats: DataFrame) -> DataFrame:
    """stats with clean: the share of 1:1 beads in percent."""
    return stats.withColumn("clean", F.try_divide(100.0 * F.col("n11"), F.col("n11") + F.col("nxx") + F.col("a_only") + F.col("b_only")))
