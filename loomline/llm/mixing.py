"""Mixing sources to target weights by a low-discrepancy schedule.

Each source gets a target number of words. The mix is a sequence of slots, each a block of equally many words: slot i takes the golden-ratio point
frac(i * phi), which cumulative weights map to a source. Slots are ranked per source, and the r-th slot of a source takes the r-th block of its
shuffled documents, laid end to end. Each pass over a document is told with the slot where it begins, which is its place in the mix. All of it is DataFrame
operations; a source with a third of all rows is ranked in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: 2**48 / golden ratio, made odd: multiples of it modulo 2**48 are the golden-ratio points.
PHI48 = 173961102589771
#: Rows of under 100 bytes up to which the documents' takes are sent to all tasks instead of being joined by a shuffle.
SEND_ROWS = 300_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, size (one row per document or per source). Returns source, source_size, weight, target, source_no, one row per source.

    Sources in code point order, null last, take the weights in turn. The targets share share * all words by weight; none is above most * its source's
    words, and what exceeds that goes to the others by weight. In order of cap / weight, the level all uncapped sources reach is the largest of
    (words left) / (weights left), so one pass over the (few) sources finds what repeated resharing would.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    order = W.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("source_no", F.row_number().over(order) - 1).withColumn("weight", F.get(kinds, F.col("source_no") % len(weights)))
    each = each.withColumn("cap", most * F.col("source_size"))
    before = W.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    each = each.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    target = F.least("cap", F.max("level").over(every) * F.col("weight"))
    return each.select("source", F.col("source_size").cast("long"), "weight", target.cast("double").alias("target"), "source_no")


def _running(df: DataFrame, key: str, group: str, order: list, value: Column, name: str) -> DataFrame:
    """df with name: the sum of value over the rows of its key that come before, where group is coarser than order. One task never holds a whole key."""
    within = W.partitionBy(key, group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(key).orderBy(group).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(key, group).agg(F.sum(value).alias("_sum"))
    sums = sums.select(key, group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [key, group]).withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within")


def schedule(quotas: DataFrame, total: int, chunk: int = 4096) -> DataFrame:
    """quotas: source_no, slots. Returns slot, source_no, rank: total slots, of which each source has exactly its quota.

    Golden-ratio points leave each source within a few slots of its quota; the last slots of sources that drew too many go, in order, to those that drew too few.
    """
    spark = quotas.sparkSession
    before = W.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)
    ranges = quotas.where("slots > 0").withColumn("lo", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("hi", F.col("lo") + F.col("slots"))
    cell = max(1, total // max(4096, 4 * quotas.count()))  # few ranges in each cell, however many sources
    ranges = ranges.select("source_no", "slots", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))).alias("cell"))
    share = F.expr(f"cast(cast(id as decimal(20, 0)) * cast({PHI48} as decimal(15, 0)) % cast({1 << 48} as decimal(15, 0)) as double)") / float(1 << 48)
    points = spark.range(total).select(F.col("id").alias("slot"), F.floor(share * total).alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {cell}"))
    drawn = points.join(ranges, "cell").where("point >= lo and point < hi").select("slot", "source_no", "slots", F.expr(f"slot div {chunk}").alias("chunk"))
    ranked = common.materialize(_running(drawn, "source_no", "chunk", ["slot"], F.lit(1), "rank").select("slot", "source_no", "slots", "rank"), "slots", narrow=True)
    kept = ranked.where("rank < slots").select("slot", "source_no", "rank")
    got = ranked.groupBy("source_no").agg(F.count("*").alias("got"))
    short = quotas.where("slots > 0").join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    spare = ranked.where("rank >= slots").select("slot", (F.row_number().over(W.orderBy("slot")) - 1).alias("nth"))
    gaps = short.select("source_no", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
    gaps = gaps.withColumn("nth", F.row_number().over(W.orderBy("rank", "source_no")) - 1)
    return kept.unionByName(spare.join(gaps, "nth").select("slot", "source_no", "rank"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block_words: int = 1024, seed: int = 20, payload: bool = False) -> DataFrame:
    """Returns doc_id, size, source_size, target, taken, passes, places and n_slots: how many words of the document each pass over its source takes (its first words), the slot of n_slots in which they begin (null where a pass takes none).

    payload=True adds row, a struct of all columns of docs. Words are runs other than space and tab to carriage return; a null text has none. Blocks have
    block_words words. Documents are shuffled by a hash of their id; rows that agree in id and size are alike.
    A null source is a source, the last one; a null id is an id like any other. Empty texts and empty tables take nothing.
    """
    spark = docs.sparkSession
    cols = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), common.n_words(F.col(text)).alias("size")]
    sized = common.materialize(docs.select(*cols), "sized", narrow=True)
    rowed = docs.select(*cols, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if payload else sized
    plan = common.materialize(targets(sized.select("source", "size"), weights, share, most).coalesce(1), "targets")
    rows, block = sized.count(), block_words
    # a pass takes whole blocks and a last part of one; the second pass begins with block 0 again
    plan = plan.withColumn("take", F.least(F.floor("target"), most * F.col("source_size"))).withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    whole = F.expr("case when source_size > 0 then take div source_size else 0 end")
    rest = F.expr("case when source_size > 0 then take % source_size else 0 end")
    plan = plan.withColumn("whole", whole).withColumn("rest", rest).withColumn("slots", F.col("whole") * F.col("blocks") + F.expr(f"(rest + {block - 1}) div {block}"))
    total = int(plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    slots = schedule(plan.select("source_no", "slots"), total)
    by_block = slots.join(plan.select("source_no", "source_size", "blocks", "whole", "rest"), "source_no").select(
        "source_no",
        "slot",
        F.expr("rank % blocks").alias("block"),
        F.expr("rank div blocks").alias("pass"),
        F.when(F.expr("rank div blocks < whole"), F.lit(block).cast("long")).otherwise(F.least(F.lit(block).cast("long"), F.col("rest") - F.expr("rank % blocks") * block)).alias("words"),
    )
    by_block = by_block.groupBy("source_no", "block").agg(F.array_agg(F.struct("pass", "words", "slot")).alias("uses"))

    groups = max(1, min(1 << 20, rows // 256))
    hashed = rowed.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("group", F.expr(f"shiftright(shiftrightunsigned(h, 34) * {groups}L, 30)"))
    hashed = hashed.join(plan.select(F.col("source").alias("_source"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = _running(hashed, "source_no", "group", ["h", "doc_id", "size"], F.col("size"), "offset")
    laid = laid.withColumn("uid", F.when(F.col("size") > 0, F.struct("source_no", "offset", "doc_id", "size")))  # offsets of documents that have words differ
    if payload:
        laid = common.materialize(laid, "laid")  # the order of rows that agree in id and size is fixed here
    spans = laid.where("size > 0").select("uid", "source_no", "offset", "size", F.explode(F.sequence(F.expr(f"offset div {block}"), F.expr(f"(offset + size - 1) div {block}"))).alias("block"))
    begin, end = F.greatest(F.col("offset") - F.col("block") * block, F.lit(0)), F.least(F.col("offset") + F.col("size") - F.col("block") * block, F.lit(block))
    used = spans.withColumn("b", begin).withColumn("e", end).join(by_block, ["source_no", "block"], "left")
    per_pass = [F.expr(f"sum(aggregate(uses, 0L, (a, u) -> a + case when u.pass = {k} then greatest(least(u.words, e) - b, 0L) else 0L end))") for k in range(most)]
    begins = [F.expr(f"min(aggregate(uses, cast(null as bigint), (a, u) -> case when u.pass = {k} and least(u.words, e) > b then least(a, u.slot) else a end))") for k in range(most)]
    taken = F.array(*[F.coalesce(F.col(f"p{k}"), F.lit(0)).cast("long") for k in range(most)]).alias("passes")
    places = F.array(*[F.col(f"s{k}") for k in range(most)]).alias("places")
    kept = ["doc_id", "size", "source_size", "target"] + ["row"] * payload
    used = used.groupBy("uid").agg(*[x.alias(f"{n}{k}") for n, of in (("p", per_pass), ("s", begins)) for k, x in enumerate(of)])
    if payload:
        used = common.materialize(used, "used", narrow=True)
        used = F.broadcast(used) if used.count() <= SEND_ROWS else used
        out = laid.join(used, "uid", "left").select(*kept, taken, places)
    else:
        none = laid.where("size = 0").select(*kept, F.array(*[F.lit(0).cast("long")] * most).alias("passes"), F.array(*[F.lit(None).cast("long")] * most).alias("places"))
        tops = plan.select("source_no", "source_size", "target")
        out = used.withColumn("source_no", F.col("uid.source_no")).join(tops, "source_no").select(F.col("uid.doc_id"), F.col("uid.size"), "source_size", "target", taken, places).unionByName(none)
    return out.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("n_slots", F.lit(total).cast("long"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes = [F.col(c)[k].alias(n) for c, names in (("passes", ("first_pass", "second_pass")), ("places", ("first_slot", "second_slot"))) for k, n in enumerate(names)]
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", *passes).coalesce(common.few(spark))
