"""The merge of two editions: blocks, alignment, confidence, chapters, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import alignment, chapters
from ..operators.tables import kept

# What the reader's style sheet is told.
BLUR, BLUR_SIDE, TOGGLE = "0.25em", "b", "Show / hide translation"


def merged(a: DataFrame, b: DataFrame, ceiling: int | None = None) -> DataFrame:
    """a, b: pair_id, seq, tag, frag. Beads with margin, doubtful, chapter and the titles of the chapters that they begin. A pair with an empty side gives none: see empty_sides()."""
    beads = kept(alignment.align(a, b, ceiling), "beads")
    return kept(chapters.of_beads(alignment.doubtful(beads).where("a_n + b_n > 0"), a, b), "chapters")


def empty_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """pair_id, status no_text of pairs without a block on a side."""
    one, other = (x.select("pair_id").distinct().withColumn(f"_{s}", F.lit(True)) for x, s in ((a, "a"), (b, "b")))
    return one.join(other, "pair_id", "full").where("_a is null or _b is null").select("pair_id", F.lit("no_text").alias("status"))


def statistics(beads: DataFrame) -> DataFrame:
    """pair_id, chapter, cid and the counts of each chapter."""
    return chapters.statistics(beads, "pair_id", "chapter").withColumn("cid", tx.chapter_id("chapter"))


def rendered(beads: DataFrame, a: DataFrame, b: DataFrame, blur_side: str = BLUR_SIDE) -> DataFrame:
    """pair_id, chapter, title, body, veiled (whether anything in it is). A division for each bead, headings as h2, all else as p, each with its language; blocks of
    blur_side that have a counterpart are veiled, and numbered through the chapter so that a link can show them."""
    parts = None
    for side, blocks in (("a", a), ("b", b)):
        cells = beads.select("pair_id", "chapter", "bead", "a_n", "b_n", "doubtful", F.explode(F.when(F.col(f"{side}_n") > 0, F.sequence(F.col(f"{side}_from"), F.expr(f"{side}_from + {side}_n - 1")))).alias("seq"))
        own = cells.join(blocks.select("pair_id", F.col("seq").cast("int").alias("seq"), "tag", "frag", "lang"), ["pair_id", "seq"])
        hidden = F.lit(side == blur_side) & (F.col("a_n") > 0) & (F.col("b_n") > 0)
        own = own.withColumn("side", F.lit(side)).withColumn("hidden", hidden)
        parts = own if parts is None else parts.unionByName(own)
    upto = W.partitionBy("pair_id", "chapter").orderBy("bead", "side", "seq").rowsBetween(W.unboundedPreceding, 0)
    name = F.when(tx.is_heading("tag"), "h2").otherwise("p")
    place = F.concat(tx.chapter_id("chapter"), F.lit("-p"), F.sum(F.col("hidden").cast("int")).over(upto).cast("string"))
    lang = tx.escaped(F.coalesce("lang", F.lit("")), quotes=True)
    attributes = F.concat(F.lit(' lang="'), lang, F.lit('" xml:lang="'), lang, F.lit('">'))
    veiled = F.concat(F.lit("<"), name, F.lit(' class="'), "side", F.lit(' blurred" id="'), "place", F.lit('"'), attributes, F.lit('<a class="peek" href="#'), "place", F.lit('">'), "frag", F.lit("</a></"), name, F.lit(">"))
    open_ = F.concat(F.lit("<"), name, F.lit(' class="'), "side", F.lit('"'), attributes, "frag", F.lit("</"), name, F.lit(">"))
    cells = parts.withColumn("place", place).withColumn("cell", F.when(F.col("hidden"), veiled).otherwise(open_))
    one_side = F.when(F.first("b_n") == 0, " only-a").when(F.first("a_n") == 0, " only-b").otherwise("")
    kind = F.concat(F.lit("pair"), one_side, F.when(F.bool_or(tx.is_heading("tag")), " sec").otherwise(""), F.when(F.first("doubtful"), " unsure").otherwise(""))
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "seq", "cell"))), lambda x: x["cell"]), "\n")
    rows = cells.groupBy("pair_id", "chapter", "bead").agg(F.concat(F.lit('<div class="'), kind, F.lit('"'), F.when(F.first("doubtful"), ' data-unsure="1">').otherwise(">"), inside, F.lit("</div>")).alias("row"), F.bool_or("hidden").alias("hidden"))
    bodies = rows.groupBy("pair_id", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bead", "row"))), lambda x: x["row"]), "\n").alias("body"), F.bool_or("hidden").alias("veiled"))
    names = beads.groupBy("pair_id", "chapter").agg(F.min_by(F.coalesce(F.nullif("title_a", F.lit("")), "title_b"), "bead").alias("title"))
    return bodies.join(names, ["pair_id", "chapter"]).select("pair_id", "chapter", tx.chapter_title("title", "chapter").alias("title"), "body", "veiled")
