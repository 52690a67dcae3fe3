"""All queries over the driver's tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import alignment, chapters, exchange, extract, languages
from ..operators.tables import kept, shared_path
from ..sources import epub, logs, zips
from ..streaming import buckets, sessions, translation
from . import books, merge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User and assistant turns of the conversations that have both."""
    turns = table(spark, sf_dir, "conversations")
    a, b = extract.from_turns(turns, "user"), extract.from_turns(turns, "assistant")
    return a.join(b.select("pair_id").distinct(), "pair_id", "left_semi"), b.join(a.select("pair_id").distinct(), "pair_id", "left_semi")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.from_lines(table(spark, sf_dir, "documents"))


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents of a source as one book."""
    own = lines(spark, sf_dir)
    order = W.partitionBy("source").orderBy(F.col("book").cast("long"), "seq")
    return own.select(F.col("source").alias("book"), (F.row_number().over(order) - 1).alias("seq"), "tag", "frag", "lang")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["alignment_stats"](spark, sf_dir)


# SQL shared by several queries

def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _trim(x: str) -> str:
    blank = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
    return f"regexp_replace({x}, '^{blank}+|{blank}+$', '', 'g')"


def _plain(x: str) -> str:
    return _trim(f"replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")


_LINES = f"""raw as (select doc_id, lang, source, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
lines as (select cast(doc_id as varchar) as book, doc_id, lang, source, cast(row_number() over (partition by doc_id order by line) - 1 as bigint) as seq, {_trim(_esc('t'))} as frag from raw where length({_trim(_esc('t'))}) > 0)"""
_SOURCES = _LINES + ", books as (select source as book, cast(row_number() over (partition by source order by doc_id, seq) - 1 as bigint) as seq, frag, lang from lines)"
_LEN = "length(regexp_replace(" + _esc("text") + ", '<[^>]+>', '', 'g'))"
_ERF = "(case when {0} = 0 then 0.0 when {0} < 6 then exp(-{0} * {0}) * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln({0}) - lgamma(k + 1.5)))) else 1.0 end)"
_COST = "-100 * ln(greatest(2 * (1 - 0.5 * (1 + " + _ERF.format("({z} / sqrt(2.0))") + ")), 1e-30))"
_Z = "(abs({x} - greatest({y} * c, 0)) / sqrt(case when {y} * c <= 0 then 1.0 else {y} * c end * 6.8))"
_PAIRS = f"""sides as (select conv_id, list({_LEN} order by turn) filter (role = 'user') as la, list({_LEN} order by turn) filter (role = 'assistant') as lb from conversations group by conv_id),
pairs as (select conv_id, la, lb, len(la) as n, len(lb) as m, list_sum(la)::double / list_sum(lb) as c from sides where la is not null and lb is not null)"""
# every path through every lattice: the lattices of conversations are tiny
_PATHS = f"""with recursive {_PAIRS},
steps(di, dj, prior) as (values (1, 1, 0.89), (1, 0, 0.0099), (0, 1, 0.0099), (2, 1, 0.089), (1, 2, 0.089), (2, 2, 0.011)),
paths as (
  select conv_id, 0 as i, 0 as j, 0.0::double as cost, '' as path from pairs
  union all
  select conv_id, i + di, j + dj, cost + -100 * ln(prior) + case when di > 0 and dj > 0 then {_COST.format(z=_Z.format(x='x', y='y'))} else 0.55 * case when di > 0 then x else y * c end end, path || di || dj
  from (
    select p.conv_id, p.i, p.j, p.cost, p.path, s.di, s.dj, s.prior, q.c,
      coalesce(list_sum(q.la[p.i + 1 : p.i + s.di]), 0)::double as x, coalesce(list_sum(q.lb[p.j + 1 : p.j + s.dj]), 0)::double as y
    from paths p join pairs q using (conv_id) join steps s on p.i + s.di <= q.n and p.j + s.dj <= q.m
  )
),
best as (select conv_id, arg_min(path, cost) as path from paths join pairs using (conv_id) where i = n and j = m group by conv_id),
beads as (
  select cast(conv_id as varchar) as pair_id, k as bead, cast(substr(path, 2 * k + 1, 1) as integer) as a_n, cast(substr(path, 2 * k + 2, 1) as integer) as b_n
  from (select conv_id, path, unnest(range(0, length(path) // 2)) as k from best)
)"""
_STATS = """select pair_id, cast(sum(a_n) as bigint) as a, cast(sum(b_n) as bigint) as b, count(*) filter (a_n = 1 and b_n = 1) as n11,
count(*) filter (a_n > 0 and b_n > 0 and not (a_n = 1 and b_n = 1)) as nxx, count(*) filter (a_n > 0 and b_n = 0) as a_only, count(*) filter (a_n = 0 and b_n > 0) as b_only from beads group by pair_id"""
_PAGES = f"""bodies as (select page_id, string_split(html, '<body>')[2] as b from pages),
found as (
  select page_id, 'h1' as tag, unnest(regexp_extract_all(b, '<h1>(.*?)</h1>', 1, 's')) as t from bodies
  union all select page_id, 'li', unnest(regexp_extract_all(b, '<li>(.*?)</li>', 1, 's')) from bodies
  union all select page_id, 'p', string_split(string_split(x, '</p>')[1], '</article>')[1] from (select page_id, unnest(string_split(b, '<p>')[2:]) as x from bodies)
),
blocks as (select page_id, tag, {_plain('t')} as text from found where length({_plain('t')}) > 0)"""
_ERRORS = "errors as (select *, cast(json_extract_string(props, '$.k') as int) as k from events where event_type = 'error')"


@query("blocks_from_documents", f"with {_LINES} select book, seq, frag, lang from lines")
def blocks_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("book", F.col("seq").cast("long").alias("seq"), "frag", "lang")


@query("block_features", f"with {_LINES} select book, count(*) as blocks, cast(sum(length(frag)) as bigint) as chars, cast(max(length(frag)) as bigint) as longest, count(distinct frag) as different from lines group by book")
def block_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(tx.strip_tags("frag"))
    return lines(spark, sf_dir).groupBy("book").agg(F.count("*").alias("blocks"), F.sum(n).alias("chars"), F.max(n).cast("long").alias("longest"), F.countDistinct("frag").alias("different"))


@query("middle_line", f"with {_LINES} select book, cast(list_sort(list(length(frag)))[len(list(frag)) // 2 + 1] as bigint) as middle from lines group by book")
def middle_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("book").agg(tx.upper_median(F.collect_list(F.length("frag"))).cast("long").alias("middle"))


@query("pair_ratio", f"with {_PAIRS} select cast(conv_id as varchar) as pair_id, cast(n as bigint) as n, cast(m as bigint) as m, round(c, 9) as ratio from pairs")
def pair_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.groupBy("pair_id").agg(F.count("*").alias(n), F.sum(F.length(tx.strip_tags("frag"))).alias(f"l{n}")) for x, n in zip(sides(spark, sf_dir), "nm"))
    chars = lambda c: F.when(F.col(c) == 0, 1).otherwise(F.col(c))
    return a.join(b, "pair_id").select("pair_id", "n", "m", F.round(chars("ln") / chars("lm"), 9).alias("ratio"))


@query("corridor_plan", f"with {_LINES}, n as (select source as book, count(*) filter (lang = 'en') as n, count(*) filter (lang = 'fr') as m from lines group by source) select book, n, m, cast(greatest(64, (8 * greatest(n, m)) // 100) as bigint) as band, cast(n * (2 * greatest(64, (8 * greatest(n, m)) // 100) + 1) as bigint) as cells, case when n * (2 * greatest(64, (8 * greatest(n, m)) // 100) + 1) > {alignment.CORRIDOR_BYTES} then 'too_big' else 'ok' end as status from n")
def corridor_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lines(spark, sf_dir).groupBy(F.col("source").alias("book")).agg(F.count_if(F.col("lang") == "en").alias("n"), F.count_if(F.col("lang") == "fr").alias("m"))
    band = F.greatest(F.lit(alignment.OPENING_BAND).cast("long"), F.expr("(8 * greatest(n, m)) div 100"))
    n = n.withColumn("band", band).withColumn("cells", F.col("n") * (2 * F.col("band") + 1))
    return n.withColumn("status", F.when(F.col("cells") > alignment.CORRIDOR_BYTES, "too_big").otherwise("ok"))


@query("step_cost_11")
def step_cost_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    sums = [x.groupBy("pair_id").agg(F.sum(F.length(tx.strip_tags("frag"))).alias(f"t{s}"), F.min_by(F.length(tx.strip_tags("frag")), "seq").cast("double").alias(s)) for x, s in ((a, "x"), (b, "y"))]
    chars = lambda c: F.when(F.col(c) == 0, 1).otherwise(F.col(c))
    rows = sums[0].join(sums[1], "pair_id").select("pair_id", "x", "y", (chars("tx") / chars("ty")).alias("ratio"))
    # no SQL: a series of its functions doesn't hold the tail past six deviations; a test compares all pairs with a plain computation
    return alignment.step_costs(rows).select("pair_id", F.round("cost", 3).alias("cost"))


@query("align_conversations", _PATHS + " select pair_id, cast(bead as integer) as bead, a_n, b_n from beads")
def align_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(*sides(spark, sf_dir), confidence=False).select("pair_id", "bead", "a_n", "b_n")


@query("path_points", _PATHS + " select pair_id, cast(bead as integer) as bead, cast(sum(a_n) over w as bigint) as i, cast(sum(b_n) over w as bigint) as j from beads window w as (partition by pair_id order by bead)")
def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = W.partitionBy("pair_id").orderBy("bead")
    return align_conversations(spark, sf_dir).select("pair_id", "bead", F.sum("a_n").over(upto).alias("i"), F.sum("b_n").over(upto).alias("j"))


@query("alignment_stats", _PATHS + " " + _STATS)
def alignment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.statistics(align_conversations(spark, sf_dir), "pair_id").drop("unsure")


@query("clean_ratio", _PATHS + f", s as ({_STATS}) select pair_id, round(100.0 * n11 / (n11 + nxx + a_only + b_only), 6) as clean from s")
def clean_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.clean_ratio(alignment_stats(spark, sf_dir)).select("pair_id", F.round("clean", 6).alias("clean"))


_MARGINS = f"""{_PATHS},
finished as (select conv_id, cost, path, len(la) as n from paths join pairs using (conv_id) where i = n and j = m),
cells as (
  select conv_id, cost, list_sum(list_transform(range(0, k + 1), lambda q: cast(substr(path, 2 * q + 1, 1) as integer))) as i, list_sum(list_transform(range(0, k + 1), lambda q: cast(substr(path, 2 * q + 2, 1) as integer))) as j
  from (select conv_id, cost, path, unnest(range(0, length(path) // 2)) as k from finished)
  union all select conv_id, cost, 0, 0 from finished
),
through as (select conv_id, i, j, min(cost) as cost from cells group by all),
least as (select conv_id, min(cost) as cost from finished group by conv_id),
ends as (select pair_id, bead, a_n, b_n, sum(a_n) over w as i, sum(b_n) over w as j from beads window w as (partition by pair_id order by bead)),
sure as (
  select e.pair_id, e.bead, e.a_n, e.b_n, coalesce(min(t.cost) - min(l.cost), 'infinity'::double) as margin
  from ends e join least l on cast(l.conv_id as varchar) = e.pair_id left join through t on t.conv_id = l.conv_id and t.i = e.i and t.j <> e.j group by all
),
limits as (select pair_id, greatest(0.25 * list_sort(list(margin))[len(list(margin)) // 2 + 1], 8.0) as least from sure where margin < 'infinity'::double group by pair_id)"""


@query("doubtful_beads", _MARGINS + " select pair_id, cast(bead as integer) as bead, a_n, b_n, round(margin, 4) as margin, coalesce(margin < least, false) as doubtful from sure left join limits using (pair_id)")
def doubtful_beads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.doubtful(alignment.align(*sides(spark, sf_dir))).select("pair_id", "bead", "a_n", "b_n", F.round("margin", 4).alias("margin"), "doubtful")


@query("align_sources_en_fr")
def align_sources_en_fr(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = by_source(spark, sf_dir)
    a, b = (books.where(F.col("lang") == x).select(F.col("book").alias("pair_id"), (F.row_number().over(W.partitionBy("book").orderBy("seq")) - 1).alias("seq"), "tag", "frag") for x in ("en", "fr"))
    beads = alignment.doubtful(alignment.align(a, b))
    return chapters.statistics(beads, "pair_id", "band", "attempts")


_MERGED = f"""{_MARGINS},
marked as (select sure.pair_id, bead, a_n, b_n, coalesce(margin < least, false) as doubtful from sure left join limits using (pair_id)),
texts as (select cast(conv_id as varchar) as pair_id, list({_esc('text')} order by turn) filter (role = 'user') as ta, list({_esc('text')} order by turn) filter (role = 'assistant') as tb from conversations group by conv_id),
placed as (
  select *, cast(sum(a_n) over w as int) as i, cast(sum(b_n) over w as int) as j, a_n > 0 and b_n > 0 as paired, cast(sum(case when a_n > 0 then b_n else 0 end) over w as int) - case when a_n > 0 then b_n else 0 end as before
  from marked window w as (partition by pair_id order by bead)
),
divisions as (
  select pair_id, bead, a_n, b_n, doubtful, paired, '<div class="pair' || case when b_n = 0 then ' only-a' when a_n = 0 then ' only-b' else '' end || case when doubtful then ' unsure" data-unsure="1">' else '">' end || array_to_string(list_concat(
    list_transform(ta[i - a_n + 1 : i], lambda x: '<p class="a" lang="user" xml:lang="user">' || x || '</p>'),
    list_transform(range(1, b_n + 1), lambda k: case when paired
      then '<p class="b blurred" id="ch001-p' || (before + k) || '" lang="assistant" xml:lang="assistant"><a class="peek" href="#ch001-p' || (before + k) || '">' || tb[j - b_n + k] || '</a></p>'
      else '<p class="b" lang="assistant" xml:lang="assistant">' || tb[j - b_n + k] || '</p>' end)), chr(10)) || '</div>' as division
  from placed join texts using (pair_id)
)
select pair_id, 1 as chapter, 'ch001' as cid, 'Chapter 1' as title, string_agg(division, chr(10) order by bead) as body, bool_or(paired) as veiled, cast(sum(a_n) as bigint) as a, cast(sum(b_n) as bigint) as b, count(*) filter (a_n = 1 and b_n = 1) as n11,
  count(*) filter (paired and not (a_n = 1 and b_n = 1)) as nxx, count(*) filter (b_n = 0) as a_only, count(*) filter (a_n = 0) as b_only, count(*) filter (doubtful) as unsure
from divisions group by pair_id"""


@query("merged_chapters", _MERGED)
def merged_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    beads = merge.merged(a, b)
    return merge.rendered(beads, a, b).join(merge.statistics(beads), ["pair_id", "chapter"])


@query("remerged_sources")
def remerged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.statistics(languages.remerge(by_source(spark, sf_dir), confidence=False), "pair_id")


@query("page_blocks", f"with {_PAGES} select cast(page_id as varchar) as book, tag, text from blocks")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.from_pages(table(spark, sf_dir, "pages")).select("book", "tag", tx.plain_text("frag").alias("text"))


@query("page_languages", "select cast(page_id as varchar) as book, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) as lang from pages")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.from_pages(table(spark, sf_dir, "pages")).groupBy("book").agg(F.min(tx.language("lang")).alias("lang"))


@query("strip_tags_pages", "select page_id, cast(length(regexp_replace(html, '<[^>]+>', '', 'g')) as bigint) as chars from pages")
def strip_tags_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(tx.strip_tags("html")).cast("long").alias("chars"))


@query("heading_levels", f"with {_PAGES} select cast(page_id as varchar) as book, cast(substr(tag, 2) as integer) as hlevel, count(*) as n from blocks where regexp_matches(tag, '^h[0-9]$') group by all")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.from_pages(table(spark, sf_dir, "pages")).groupBy("book", tx.heading_level("tag").alias("hlevel")).agg(F.count("*").alias("n")).where("hlevel is not null")


@query("chapter_level", f"with {_PAGES}, n as (select page_id, cast(substr(tag, 2) as integer) as l, count(*) as n from blocks where regexp_matches(tag, '^h[0-9]$') group by all), p as (select distinct page_id from blocks) select cast(p.page_id as varchar) as book, coalesce(min(l) filter (n > 1), min(l)) as level from p left join n using (page_id) group by p.page_id")
def chapter_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.level(extract.from_pages(table(spark, sf_dir, "pages")), "book")


_HEADED = "heads as (select book, seq, frag, case when length(frag) < 40 then 'h2' else 'p' end as tag from lines)"


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the short ones as headings: documents have none of their own."""
    return lines(spark, sf_dir).withColumn("tag", F.when(F.length("frag") < 40, "h2").otherwise("p"))


@query("chapter_cuts", f"with {_LINES}, {_HEADED}, c as (select book, seq, sum(case when tag = 'h2' then 1 else 0 end) over (partition by book order by seq) as k from heads) select book, seq, dense_rank() over (partition by book order by k) as chapter from c")
def chapter_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.of_blocks(headed(spark, sf_dir), "book").select("book", F.col("seq").cast("long").alias("seq"), F.col("chapter").cast("long").alias("chapter"))


@query("chapter_titles", f"with {_LINES}, {_HEADED}, c as (select book, seq, frag, tag, sum(case when tag = 'h2' then 1 else 0 end) over (partition by book order by seq) as k from heads), d as (select *, dense_rank() over (partition by book order by k) as chapter from c) select book, chapter, format('ch{{:03d}}', chapter) as cid, coalesce(nullif(arg_min(case when tag = 'h2' then frag else '' end, seq), ''), 'Chapter ' || chapter) as title, count(*) as blocks from d group by book, chapter")
def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chapters.titles(chapters.of_blocks(headed(spark, sf_dir), "book"), "book")
    return own.select("book", F.col("chapter").cast("long").alias("chapter"), tx.chapter_id("chapter").alias("cid"), tx.chapter_title("title", "chapter").alias("title"), "blocks")


@query("lang_order", f"with {_SOURCES}, f as (select book, coalesce(nullif(lang, ''), 'und') as lang, min(seq) as s, count(*) as blocks from books group by all) select book, lang, row_number() over (partition by book order by s, lang) - 1 as rank, blocks from f")
def lang_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.order(by_source(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("split_by_lang", f"with {_SOURCES} select book, lang, cast(row_number() over (partition by book, lang order by seq) - 1 as bigint) as seq, frag from books where lang in ('en', 'de')")
def split_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.split(by_source(spark, sf_dir), ["en", "de", "tlh"]).select("book", "lang", F.col("seq").cast("long").alias("seq"), "frag")


@query("remerge_langs", f"with {_SOURCES}, l as (select book, list_sort(list(distinct lang)) as l from books group by book) select book, l[1] as lang_a, l[2] as lang_b, case when len(l) > 1 then 'ok' else 'one_language' end as status from l")
def remerge_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.pair_of(by_source(spark, sf_dir))


_EXPORT = f"x as (select book, seq as i, {_plain('frag')} as text from lines)"


@query("export_blocks", f"with {_LINES}, {_EXPORT} select book, i, 'p' as tag, text from x")
def export_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.export(lines(spark, sf_dir)).withColumn("i", F.col("i").cast("long"))


@query("estimate_requests", f"with {_LINES}, {_EXPORT} select book, count(*) as blocks, cast(sum(length(text)) as bigint) as chars, (count(*) + 19) // 20 as requests from x group by book")
def estimate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.estimate(exchange.export(lines(spark, sf_dir)))


@query("translation_todo", f"with {_LINES}, {_EXPORT} select book, i, (row_number() over (partition by book order by i) - 1) // 20 as batch from x where i % 3 <> 0")
def translation_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = exchange.export(lines(spark, sf_dir))
    return exchange.todo(own, own.where("i % 3 = 0")).select("book", F.col("i").cast("long").alias("i"), F.col("batch").cast("long").alias("batch"))


@query("validate_translation", f"with {_LINES}, {_EXPORT}, g as (select book, i, case when i % 7 = 5 then '' else text end as text from x where not (cast(book as bigint) % 3 = 0 and i = 0)) select x.book, count(*) as want, count(g.i) as got, case when count(*) <> count(g.i) then 'wrong_count' when count(*) filter (g.text = '') > 0 then 'empty_items' else 'ok' end as status from x left join g using (book, i) group by x.book")
def validate_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = exchange.export(lines(spark, sf_dir))
    got = own.where(~((F.col("book").cast("long") % 3 == 0) & (F.col("i") == 0))).withColumn("text", F.when(F.col("i") % 7 == 5, "").otherwise(F.col("text")))
    return exchange.validate(own, got).select("book", "want", "got", "status")


@query("translated_blocks", f"with {_LINES}, {_EXPORT} select book, i, '[' || text || ']' as text, 'done' as status from x where i % 2 = 0")
def translated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    own = exchange.export(lines(spark, sf_dir))
    done = exchange.translate(own, lambda texts: json.dumps([f"[{t}]" for t in texts]), own.where("i % 2 = 1"))
    return done.withColumn("i", F.col("i").cast("long"))


@query("resumed_translation", f"with {_LINES}, {_EXPORT} select book, i, '[' || text || ']' as text, i % 2 = 0 as had from x")
def resumed_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation of which a first run has done half when the stream of all documents begins; had: whether the cache had the block before the stream."""
    import json

    path = shared_path(spark, "translation")
    provider = lambda texts: json.dumps([f"[{t}]" for t in texts])
    translation.resume(exchange.export(lines(spark, sf_dir)).where("i % 2 = 0"), provider, f"{path}/cache", "first")
    docs = f"{sf_dir}/documents.parquet"
    # a pattern, as a stream takes no single file
    blocks = extract.from_lines(spark.readStream.schema(spark.read.parquet(docs).schema).parquet(f"{docs}*"))
    translation.stream(exchange.export(blocks), provider, f"{path}/cache", f"{path}/checkpoint", "second").awaitTermination()
    return spark.read.parquet(f"{path}/cache").select("book", F.col("i").cast("long").alias("i"), "text", (F.col("run") == "first").alias("had"))


_TRANSLATED = f"""with {_LINES}, {_EXPORT}, k as (select book, cast(book as bigint) % 5 as kind, i, text from x)
select book, 'ok' as status, cast(i as int) as i, case kind when 2 then 'line ' || i else text end as text, coalesce(case kind when 1 then 'xx' end, '') as target_lang from k where kind < 3
union all select distinct book, 'bad_translation', -1, '', case kind when 4 then 'yy' else '' end from k where kind >= 3"""


@query("translation_files", _TRANSLATED)
def translation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of translations in every shape by their id: a list, an object with blocks, lines, a number, and an object without blocks."""
    own = exchange.export(lines(spark, sf_dir))
    texts = F.array_sort(F.collect_list(F.struct("i", "text")))
    one = own.groupBy("book").agg(texts.alias("t")).withColumn("kind", F.col("book").cast("long") % 5)
    plain = F.transform("t", lambda x: x["text"])
    text = (
        F.when(F.col("kind") == 0, F.to_json(plain))
        .when(F.col("kind") == 1, F.to_json(F.struct(F.lit("xx").alias("target_lang"), F.transform("t", lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text"))).alias("blocks"))))
        .when(F.col("kind") == 2, F.array_join(F.transform("t", lambda x: F.concat(F.lit(" line "), x["i"].cast("string"))), "\n\n"))
        .when(F.col("kind") == 3, "5")
        .otherwise('{"lang": "yy"}')
    )
    got = exchange.read_translations(one.select("book", text.alias("text")))
    return got.select("book", "status", F.coalesce("i", F.lit(-1)).alias("i"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("target_lang", F.lit("")).alias("target_lang"))


@query("killed_jobs", "select cast(s.user_id as varchar) as job, s.event_id, 'Killed' as error_type from events s where s.event_type = 'signup' and not exists (select 1 from events f where f.event_type = 'purchase' and f.user_id = s.user_id and f.ts between s.ts and s.ts + interval 12 hour)")
def killed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as the starts of users' jobs and purchases as their ends: those that nothing ended within twelve hours."""
    own = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("job"), F.col("ts").alias("at_ts"))
    return logs.killed(own.where("event_type = 'signup'"), own.where("event_type = 'purchase'"), "12 hours").select("job", "event_id", "error_type")


@query("epub_round_trip", f"with {_LINES} select source as book, count(*) as blocks, cast(sum(length(frag)) as bigint) as chars from lines group by source")
def epub_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written from the sources' documents, a chapter for each, and read again."""
    docs = table(spark, sf_dir, "documents")
    own = lines(spark, sf_dir).groupBy("source", "book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frag"))), lambda x: F.concat(F.lit("<p>"), x["frag"], F.lit("</p>"))), "\n").alias("body"))
    name = F.concat("source", F.lit(".epub"))
    title = F.concat(F.lit("Document "), "book")
    pages = own.select(name.alias("book"), (F.col("book").cast("int") + 1).alias("chapter"), title.alias("title"), books.page(title, F.col("body")).alias("page"), F.lit(False).alias("scripted"))
    meta = docs.select("source").distinct().select(name.alias("book"), F.col("source").alias("title"), F.array(F.lit("nobody")).alias("creators"), F.array(F.lit("en")).alias("languages"), *[F.lit(None).cast(t).alias(c) for c, t in (("publisher", "string"), ("description", "string"), ("cover", "binary"))])
    path = shared_path(spark, "books")
    zips.write(books.members(pages, meta), path)
    read = kept(epub.documents(spark, path), "read")
    return epub.blocks_of(read.withColumn("path", F.col("title"))).groupBy("book").agg(F.count("*").alias("blocks"), F.sum(F.length("frag")).alias("chars"))


#: A picture of one pixel, so that books have a cover.
PIXEL = "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg=="


def conversation_books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of each conversation as the packages of two books: a page with a paragraph for each turn; those of users have covers."""
    sides_ = []
    for role, cover in (("user", F.unbase64(F.lit(PIXEL))), ("assistant", F.lit(None).cast("binary"))):
        own = extract.from_turns(table(spark, sf_dir, "conversations"), role)
        html = F.concat(F.lit("<body>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frag"))), lambda x: F.concat(F.lit("<p>"), x["frag"], F.lit("</p>"))), ""), F.lit("</body>"))
        one = own.groupBy("pair_id").agg(html.alias("html"))
        spine = F.array(F.struct(F.lit(0).alias("position"), F.lit("p.xhtml").alias("href"), F.col("html").alias("html")))
        sides_.append(one.select(F.concat("pair_id", F.lit(".epub")).alias("pair_id"), F.lit("ok").alias("status"), F.concat(F.lit(role + " "), "pair_id").alias("title"), F.array(F.lit("Both"), F.lit(role)).alias("creators"), F.array(F.lit("en" if role == "user" else "fr")).alias("languages"), cover.alias("cover"), spine.alias("spine")))
    return sides_[0], sides_[1]


_BOTH = "t as (select conv_id, count(*) filter (role = 'user') as a, count(*) filter (role = 'assistant') as b, sum(length(text)) filter (role = 'user') as chars_a, sum(length(text)) filter (role = 'assistant') as chars_b from conversations where length(trim(text)) > 0 group by conv_id)"


@query("merged_books", f"with {_BOTH} select conv_id || '.epub' as book, 'user ' || conv_id || ' / assistant ' || conv_id as title, 'Both, user, assistant' as creators, 'en, fr' as languages, true as covered, a, b, cast(chars_a as bigint) as chars_a, cast(chars_b as bigint) as chars_b from t where a > 0 and b > 0")
def merged_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of both sides of each conversation, merged, written as archives and read again: what they say of themselves, and the blocks of each language."""
    path = shared_path(spark, "merged")
    zips.write(books.merged(*conversation_books(spark, sf_dir)).members, path)
    read = kept(epub.documents(spark, path).withColumn("path", F.substring_index("path", "/", -1)), "read")
    n = F.length(tx.unescaped(tx.strip_tags("frag")))
    counts = epub.blocks_of(read).groupBy("book").agg(*[f(F.col("lang") == x, n).alias(f"{o}{s}") for s, x in (("a", "en"), ("b", "fr")) for o, f in (("", lambda c, n: F.count_if(c)), ("chars_", lambda c, n: F.sum(F.when(c, n))))])
    about = read.where("coalesce(position, 0) = 0").select(F.col("path").alias("book"), "title", F.array_join("creators", ", ").alias("creators"), F.array_join("languages", ", ").alias("languages"), (tx.cover_type("cover") == "image/png").alias("covered"))
    return about.join(counts, "book")


@query("archive_shapes", f"with {_BOTH} select conv_id || '.epub' as name, 10 as entries, true as is_zip, true as has_container, 'application/epub+zip' as mimetype, false as encrypted, 'OEBPS/content.opf' as opf, 3 as xhtml, 'x' as first from t where a > 0 and b > 0")
def archive_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of the archives of merged books, by their central directories."""
    path = shared_path(spark, "merged")
    zips.write(books.merged(*conversation_books(spark, sf_dir)).members, path)
    own = epub.fingerprint(zips.read(spark, path))
    return own.select(F.substring_index("path", "/", -1).alias("name"), F.col("entries").cast("int").alias("entries"), "is_zip", "has_container", "mimetype", "encrypted", F.get("opf", F.lit(0)).alias("opf"), F.col("by_extension")[".xhtml"].cast("int").alias("xhtml"), F.get("sample_entries", F.lit(0)).alias("first"))


@query("imported_books", f"with {_LINES}, {_EXPORT}, n as (select book, count(*) as want, count(*) filter (i % 11 <> 10) as got from x group by book) select book, case when want = got then 'ok' else 'wrong_count' end as status, case when want = got then 'Document ' || book || ' (xx)' end as title, case when want = got then want else 0 end as blocks from n")
def imported_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and a translation that lacks the last of each eleven blocks, built into books and read again."""
    own = kept(exchange.export(lines(spark, sf_dir)), "exported")
    got = own.where("i % 11 != 10").withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))
    meta = own.select("book").distinct().select("book", F.concat(F.lit("Document "), "book").alias("title"), F.array().cast("array<string>").alias("creators"), F.lit("en").alias("lang"), F.lit("xx").alias("target_lang"))
    made = books.imported(own, got, meta)
    path = shared_path(spark, "imported")
    zips.write(made.members.withColumn("archive", F.concat("archive", F.lit(".epub"))), path)
    read = kept(epub.documents(spark, path).withColumn("path", F.regexp_extract("path", r"([^/]*)\.epub$", 1)), "read")
    blocks = epub.blocks_of(read).where("lang = 'xx' and frag like '[%]'").groupBy("book").agg(F.count("*").alias("blocks"))
    return made.status.join(read.where("coalesce(position, 0) = 0").select(F.col("path").alias("book"), "title"), "book", "left").join(blocks, "book", "left").fillna(0, ["blocks"])


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every shape by k modulo 6: a bare and a quoted file, a path in a text of over 150 characters that differs after them, none, an empty one, and neither error nor type."""
    own = table(spark, sf_dir, "events").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k")
    kind = k.cast("int") % 6
    long = F.concat(F.lit("cannot read /srv/in/k"), k, F.lit("/x "), F.repeat(F.lit("and more "), F.lit(20)), (k.cast("int") % 4).cast("string"))
    error = F.when(kind == 0, F.concat(F.lit("cannot open /srv/in/k"), k, F.lit("/my book.epub"))).when(kind == 1, F.concat(F.lit("no part in '"), k, F.lit(" of it.ZIP'"))).when(kind == 2, long).when(kind == 4, "")
    return own.select("event_id", "ts", "user_id", error.alias("error"), F.when(kind < 5, "ValueError").alias("error_type"), k.alias("k"))


_REASONS = f"""with {_ERRORS}, r as (
  select event_id, case k % 6 when 0 then 'cannot open <file>' when 1 then 'no part in ''<file>''' when 2 then 'cannot read <path> ' || repeat('and more ', 20) || (k % 4) when 5 then 'unknown' else 'ValueError' end as reason from errors
)
select reason, count(*) as n, min(event_id) as first from r group by reason"""


@query("failure_digest", _REASONS)
def failure_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.reasons(errors(spark, sf_dir), "event_id")


@query("failures_by_kind", "select 'kind ' || json_extract_string(props, '$.k') as reason, count(*) as n, min(event_id) as first from events where event_type = 'error' group by 1")
def failures_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.reasons(errors(spark, sf_dir).withColumn("error", F.concat(F.lit("kind "), "k")), "event_id")


@query("failure_since", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') as at from events where event_type = 'error' and ts >= timestamp '2024-01-31' - interval 7 day")
def failure_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = tx.cutoff("7d", F.to_timestamp(F.lit("2024-01-31 00:00:00")))
    return errors(spark, sf_dir).where(F.col("ts") >= since).select("event_id", tx.iso_utc("ts").alias("at"))


@query("reports_open", "select count(*) filter (event_id % 3 <> 0) as reports_open, count(*) filter (event_id % 3 <> 0 and event_id % 2 = 0) as reports_awaiting_reply, count(*) as failures from events where event_type = 'error'")
def reports_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = errors(spark, sf_dir)
    reports = own.select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 3 == 0, tx.iso_utc("ts")).alias("resolved_at"), F.when(F.col("event_id") % 2 == 0, F.lit("a@b.example")).alias("notify"))
    return logs.digest(own.withColumn("at", tx.iso_utc("ts")), reports).select("reports_open", "reports_awaiting_reply", "failures")


@query("failures_per_day", "select date_trunc('day', ts)::timestamp as start, 'error' as endpoint, count(*) as failures from events where event_type = 'error' group by 1")
def failures_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.failure_windows(errors(spark, sf_dir).select(F.col("ts").alias("at_ts"), F.lit("error").alias("endpoint")))


# from the rule: a url that ends as a data file is one, from the colon on; of another the colon and a slash stay, and of what follows only a single name
_SCRUB = f"""with u as (select page_id, split_part(url, '//', 1) as scheme, split_part(split_part(url, '?', 1), '.', -1) as ending, list_filter(string_split(substr(url, strpos(url, '//') + 2), '/'), lambda x: x <> '') as names, substr(url, length(split_part(url, '?', 1)) + 1) as query from pages)
select page_id, 'failed at <path> in /srv/app/read.py "<file>" of ' || scheme || case when list_contains({list(tx.DATA_FILES)}, ending) then '<file>' || query when len(names) >= 2 then '/<path>' else '//' || names[1] end as error from u"""


@query("scrub_paths", _SCRUB)
def scrub_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", tx.scrubbed(F.concat(F.lit("failed at /srv/books/"), page, F.lit('/x in /srv/app/read.py "my page '), page, F.lit('.html" of '), "url")).alias("error"))


@query("anon_names", r"select page_id, 'OEBPS/' || left(regexp_replace(regexp_replace('Chapter ' || page_id || 'b', '\p{Nd}+', '#', 'g'), '[\p{L}\p{Nl}\p{No}]+', 'x', 'g'), 32) || '.xhtml' as name from pages")
def anon_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("OEBPS/Chapter "), F.col("page_id").cast("string"), F.lit("b.xhtml"))
    return table(spark, sf_dir, "pages").select("page_id", tx.anonymous_name(name).alias("name"))


@query("slugs", r"select page_id, regexp_replace(url, '[^\pL\p{Nd}_.-]+', '_', 'g') as slug from pages")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.slug("url").alias("slug"))


@query("token_bucket", """with recursive e as (select cast(user_id as varchar) as key, epoch_us(ts) / 1e6 as tm, event_id as id, row_number() over (partition by user_id order by epoch_us(ts) / 1e6, event_id) as rn from events),
r as (
  select key, tm, id, rn, true as admitted, 3.0::double as tokens from e where rn = 1
  union all
  select key, tm, id, rn, t >= 1, case when t >= 1 then t - 1 else t end
  from (select e.key, e.tm, e.id, e.rn, case when e.tm - r.tm > 3600 then 4.0 else least(4.0, r.tokens + (e.tm - r.tm) * (12.0::double / 300.0::double)) end as t from r join e on e.key = r.key and e.rn = r.rn + 1)
)
select key, id, admitted from r""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("id"))
    return buckets.token_bucket(own).select("key", "id", "admitted")


@query("session_ttl", "with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 1800000000 then 1 else 0 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g) select user_id, cast(session as bigint) as session, count(*) as events, min(event_id) as first from s group by all")
def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = buckets.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    return own.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first"))


_QUOTA = """with recursive f as (select source as session, doc_id as seq, n_chars as size, row_number() over (partition by source order by doc_id) as k from documents),
r as (
  select session, seq, k, size <= 60000 as accepted, case when size <= 60000 then 1 else 0 end as n, case when size <= 60000 then size else 0 end as used from f where k = 1
  union all
  select session, seq, k, ok, n + case when ok then 1 else 0 end, used + case when ok then size else 0 end
  from (select f.session, f.seq, f.k, f.size, r.n, r.used, r.n < 40 and r.used + f.size <= 60000 as ok from r join f on f.session = r.session and f.k = r.k + 1)
)
select session, seq, accepted from r"""


@query("session_quota", _QUOTA)
def session_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of their source's session: those for which there is room."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("bytes"))
    return buckets.quota(files, max_bytes=60_000).drop("bytes")


#: Short sessions with little room, so that events meet each rule.
LIMITS = sessions.Limits(ttl=6 * 3600, max_files=3, max_bytes=600)


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what happens to a user's session; files and tokens are told by their k."""
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "open", "view", "touch", "click", "add", "purchase", "fetch", "error", "add")])
    own = table(spark, sf_dir, "events").where("user_id is not null")
    return own.select(
        F.col("user_id").cast("string").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("id"),
        kinds[F.col("event_type")].alias("kind"), F.concat(F.lit("t"), (k % 4).cast("string")).alias("token"), (k * 4).cast("long").alias("bytes"),
    )


_SESSIONS = """with recursive e as (
  select cast(user_id as varchar) as session, event_id as id, epoch_us(ts) / 1e6 as tm, case event_type when 'signup' then 'open' when 'view' then 'touch' when 'purchase' then 'fetch' else 'add' end as kind,
    cast(json_extract_string(props, '$.k') as int) % 4 as token, 4 * cast(json_extract_string(props, '$.k') as int) as size, row_number() over (partition by user_id order by epoch_us(ts) / 1e6, event_id) as rn from events
),
r as (
  select session, id, rn, kind = 'open' as accepted, kind = 'open' as lives, tm as seen, 0 as n, 0 as used, cast([] as int[]) as tokens from e where rn = 1
  union all
  select session, id, rn, case kind when 'open' then true when 'touch' then alive when 'fetch' then alive and list_contains(tokens, token) else room end, kind = 'open' or alive, case when kind <> 'add' then tm else seen end,
    case when kind = 'open' or not alive then 0 when room then n + 1 else n end, case when kind = 'open' or not alive then 0 when room then used + size else used end,
    case when kind = 'open' or not alive then cast([] as int[]) when room then list_append(tokens, token) else tokens end
  from (
    select *, kind = 'add' and alive and n < 3 and used + size <= 600 as room
    from (select e.*, r.seen, r.n, r.used, r.tokens, r.lives and e.tm - r.seen <= 21600 as alive from r join e on e.session = r.session and e.rn = r.rn + 1)
  )
)
select session, id, accepted, cast(n as int) as files, cast(used as bigint) as used from r"""


@query("session_decisions", _SESSIONS)
def session_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sessions of users accept, as their files and time to live allow."""
    return sessions.decisions(session_events(spark, sf_dir), LIMITS).select("session", "id", "accepted", "files", "used")
