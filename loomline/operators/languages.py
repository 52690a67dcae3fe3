"""Partition of books by language, and the pairing of two languages of one book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from . import alignment, chapters


def order(blocks: DataFrame) -> DataFrame:
    """book, lang, rank (from 0 by first appearance), blocks."""
    seen = blocks.groupBy("book", tx.language("lang").alias("lang")).agg(F.min("seq").alias("first"), F.count("*").alias("blocks"))
    return seen.select("book", "lang", (F.row_number().over(W.partitionBy("book").orderBy("first", "lang")) - 1).alias("rank"), "blocks")


def split(blocks: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """blocks with part (book and language), and seq and chapters of the part's own. Languages asked for but absent give nothing, the others are left out."""
    own = blocks.withColumn("lang", tx.language("lang"))
    own = own.where(F.col("lang").isin(langs)) if langs is not None else own
    own = own.withColumn("part", F.concat_ws("|", "book", "lang")).withColumn("seq", F.row_number().over(W.partitionBy("part").orderBy("seq")) - 1)
    return chapters.of_blocks(own, "part")


def pair_of(blocks: DataFrame) -> DataFrame:
    """book, lang_a, lang_b, status: the first two languages by name; one_language where there are fewer."""
    own = blocks.groupBy("book").agg(F.sort_array(F.collect_set(tx.language("lang"))).alias("langs"))
    return own.select("book", F.get("langs", F.lit(0)).alias("lang_a"), F.get("langs", F.lit(1)).alias("lang_b"), F.when(F.size("langs") > 1, "ok").otherwise("one_language").alias("status"))


def rendered(blocks: DataFrame) -> DataFrame:
    """Tags as a written book has them: any heading is h2, all else p."""
    return blocks.withColumn("tag", F.when(tx.is_heading("tag"), "h2").otherwise("p"))


def remerge(blocks: DataFrame, confidence: bool = True) -> DataFrame:
    """Beads of each book's two languages, as if the parts had been written and read again. pair_id is the book."""
    both = rendered(blocks).withColumn("lang", tx.language("lang")).join(pair_of(blocks).where("status = 'ok'"), "book")

    def side(lang: str) -> DataFrame:
        own = both.where(F.col("lang") == F.col(lang))
        return own.select(F.col("book").alias("pair_id"), (F.row_number().over(W.partitionBy("book").orderBy("seq")) - 1).alias("seq"), "tag", "frag")

    return alignment.align(side("lang_a"), side("lang_b"), confidence=confidence)
