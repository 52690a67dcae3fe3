"""What filters remove in every order: a relational word pipeline.

Texts are grouped by 128-bit fingerprints, so copies are looked at once. The words of each different text are exploded, aggregated by (text, word) and then by
text, and outer-joined to the flags that need no words; both aggregations use the partitioning by text, so no word is ever shuffled. Each part then is 32
conditional counts, one for each set of failed filters, from which every order of the filters follows by arithmetic on a few numbers.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
SPACES, BREAK = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
#: A text that more than one in so many rows share is joined by broadcast: there can be no more of them.
COMMON = 1000


def text_facts(base: DataFrame) -> DataFrame:
    """base: h1, h2, doc_id, text. One row for each different text: first (its least doc_id), n (rows), and mask, the filters that it fails on its own: A under 200
    words, B under half of them different, C over 3 % capitals, D a character of the list."""
    texts = base.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
    words = texts.select("h1", "h2", F.explode(F.split(F.btrim("text", F.lit(SPACES)), BREAK)).alias("word")).where("word != ''")
    # texts are partitioned by (h1, h2): neither step shuffles
    pairs = words.groupBy("h1", "h2", "word").agg(F.count("*").alias("times"))
    totals = pairs.groupBy("h1", "h2").agg(F.sum("times").alias("words"), F.count("*").alias("different"))
    capitals = 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 3 * F.length("text")
    own = texts.select("h1", "h2", "first", "n", capitals.alias("capitals"), F.rlike("text", F.lit("[#$%&*|]")).alias("marks"))
    words, different = (F.coalesce(c, F.lit(0)) for c in ("words", "different"))
    fails = (words < 200, 100 * different < 50 * words, F.col("capitals"), F.col("marks"))
    return own.join(totals, ["h1", "h2"], "left").select("h1", "h2", "first", "n", _bits(fails).alias("mask"))


def _bits(fails: tuple[Column, ...]) -> Column:
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: rows of each part by the set of filters they fail (bit k is the k-th filter) and by their labels."""
    spark = docs.sparkSession
    common.tune(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    facts = common.materialize(text_facts(base), "text-facts")
    rows = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = facts.where(F.col("n") > rows // COMMON)

    # rows that repeat an id and a text are one with a count, and rows without an id, which have no labels, are spread by their text
    own = base.groupBy("doc_id", "part", "h1", "h2").agg(F.count("*").alias("rows"))
    own = own.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("h1")).otherwise(F.lit(0)))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c) == 1, F.lit(False)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))])
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    own = own.join(marks, ["doc_id", "spread"], "left").drop("spread")

    # texts with very many rows come by broadcast; the rows of the others meet their text in a shuffle, in which the former match nothing and are spread by id
    hot = often.select("h1", "h2", F.col("mask").alias("hot_mask"), F.col("first").alias("hot_first"))
    own = own.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("spread", F.when(F.col("hot_mask").isNotNull(), F.xxhash64("doc_id")).otherwise(F.lit(0)))
    rare = facts.where(F.col("n") <= rows // COMMON).select("h1", "h2", "mask", "first", F.lit(0).cast("long").alias("spread"))
    own = own.join(rare, ["h1", "h2", "spread"], "left")
    mask, first = F.coalesce("hot_mask", "mask"), F.coalesce("hot_first", "first")
    again = F.when(F.col("doc_id") > first, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    good, toxic = (F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    return own.select("part", (mask + again).alias("mask"), good, toxic, "rows").groupBy("part", "mask", "good", "toxic").agg(F.sum("rows").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The filters A to D are those of text_facts(); E: a smaller doc_id has the same text. Null text is empty, null lang is the part ''. A row without an id is
    no copy of any and has no labels; rows of one id are not smaller than each other; a label that one of an id's label rows has counts. An empty table has no parts.
    """
    sets = failed_sets(docs, labels)

    def counts(of: Column, name: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & of, F.col("n"))), F.lit(0)) for m in range(MASKS)]).alias(name)

    parts = sets.groupBy("part").agg(counts(F.lit(True), "all"), counts(F.col("good"), "good"), counts(F.col("toxic"), "toxic"))
    orders = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.expr(f"sequence(1, {len(FILTERS)})")))
    bit = f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {{}}, 1)) - 1)"
    orders = orders.withColumn("bit", F.expr(bit.format("step"))).withColumn("before", F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (s, i) -> if(i < step, s | {bit.format('i')}, s))"))

    def total(where: str, of: str = "all", times: str = "1") -> Column:
        return F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (s, m) -> if({where}, s + {of}[m] * {times}, s))")

    goes = "m & before = 0 and m & bit != 0"
    return orders.select(
        "part", "filter_order", "step", total("m & (before | bit) = 0").alias("kept"), total(goes).alias("removed"), total("m & before != 0 and m & bit != 0").alias("redundant"),
        total("m = bit").alias("unique_fails"), total(goes, "good").alias("good_lost"), total(goes, "toxic").alias("toxic_lost"),
        # of all orders, a filter comes first among the filters that a row fails in one of as many as these are
        total("m & bit != 0", times=f"cast({len(ORDERS)} div bit_count(m) as bigint)").alias("shapley"),
    )


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, max(quality) as good, max(toxic) as toxic from labels group by doc_id),
f as (
  select part, good = 1 as good, toxic = 1 as toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > first] as fails
  from w left join l using (doc_id)
),
m as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
i as (select unnest(range(1, 6)) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as o from i a, i b, i c, i d, i e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (
  select part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') as filter_order, i as step, n, good, toxic,
    fails[o[i]] as fails_this, len(list_filter(o[1 : i - 1], lambda x: fails[x])) > 0 as gone, len(list_filter(fails, lambda x: x)) as fail_count
  from m, o, i
)
select part, filter_order, cast(step as integer) as step, cast(sum(case when not gone and not fails_this then n else 0 end) as bigint) as kept,
  cast(sum(case when not gone and fails_this then n else 0 end) as bigint) as removed, cast(sum(case when gone and fails_this then n else 0 end) as bigint) as redundant,
  cast(sum(case when fails_this and fail_count = 1 then n else 0 end) as bigint) as unique_fails, cast(sum(case when not gone and fails_this then good else 0 end) as bigint) as good_lost,
  cast(sum(case when not gone and fails_this then toxic else 0 end) as bigint) as toxic_lost, cast(sum(case when fails_this then n * 120 // fail_count else 0 end) as bigint) as shapley
from s group by all"""
