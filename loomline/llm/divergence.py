"""How sources of a language differ in what they say, with exact integers.

A byte-level tokenizer marks term bytes by a lookup table over the concatenated UTF-8 of a batch; its slices are grouped by XXH64 and each is compared with its
group's first slice byte by byte. Counts are combined within a task and then by (lang, term). Blocks of kept terms become CSR matrices (sources by terms) whose
rows are compared by reduceat; the sums of all blocks are the divergences, so that no task holds a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Documents of its language that a kept term is in at least; ranks of terms that a group returns.
LEAST_DOCS, TOP_TERMS = 30, 50
#: A count is raised by this before it becomes a share of SCALE.
PRIOR, SCALE = 5, 1_000_000_000
#: Rows that a task combines before it sends them on, entries of a block of terms, and groups up to which their totals are broadcast.
FLUSH_ROWS, BLOCK_ENTRIES, SEND_GROUPS = 400_000, 200_000, 100_000

_TERM_BYTES = np.zeros(256, bool)
_TERM_BYTES[65:91] = _TERM_BYTES[97:123] = _TERM_BYTES[128:] = True

# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _read(data: np.ndarray, kind: str) -> np.ndarray:
    """data, followed by 8 more bytes, as little-endian numbers of the kind that begin at each of its places."""
    return np.ndarray((len(data) - 8,), kind, data, strides=(1,))


def xxh64(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 of the slices. Those under 32 bytes are hashed together, step by step; data has 8 bytes to spare at its end."""
    size = end - begin
    h = _P5 + size.astype(np.uint64)
    at, left = begin.copy(), size.copy()
    eight, four = _read(data, "<u8"), _read(data, "<u4")
    while len(i := np.flatnonzero((left >= 8) & (size < 32))):
        h[i] = _rotated(h[i] ^ (_rotated(eight[at[i]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero((left >= 4) & (size < 32))
    h[i] = _rotated(h[i] ^ (four[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[i] += 4
    left[i] -= 4
    while len(i := np.flatnonzero((left > 0) & (size < 32))):
        h[i] = _rotated(h[i] ^ (data[at[i]].astype(np.uint64) * _P5), 11) * _P1
        at[i] += 1
        left[i] -= 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= 32):
        h[k] = xxhash.xxh64_intdigest(data[begin[k] : end[k]].data)
    return h


def _differ(data: np.ndarray, begin: np.ndarray, end: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which slices don't have the bytes of the slices that `of` names."""
    size = end - begin
    wrong = size != size[of]
    eight = _read(data, "<u8")
    go, step = np.flatnonzero(~wrong), 0
    while len(go := go[size[go] > step]):
        over = np.maximum(step + 8 - size[go], 0).astype(np.uint64) * np.uint64(8)
        wrong[go] |= (eight[begin[go] + step] << over) != (eight[begin[of[go]] + step] << over)
        go, step = go[~wrong[go]], step + 8
    return wrong


def grouped(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slice the number of its term, and for each term its first slice. Equal numbers mean equal bytes."""
    codes, _ = pd.factorize(xxh64(data, begin, end))
    firsts = _firsts(codes)
    wrong = np.flatnonzero(_differ(data, begin, end, firsts[codes])) if len(codes) else codes
    if len(wrong):  # slices of one hash with other bytes: numbered by the bytes themselves
        codes[wrong] = len(firsts) + pd.factorize(np.array([data[begin[k] : end[k]].tobytes() for k in wrong], object))[0]
        order = pd.factorize(codes)[0]
        return order, _firsts(order)
    return codes, firsts


def _firsts(codes: np.ndarray) -> np.ndarray:
    """Where each number stands first; numbers are given in that order."""
    return np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1)) if len(codes) else np.zeros(0, np.int64)


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - begin
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    flat = data[np.arange(at[-1]) + np.repeat(begin - at[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.string())


def term_counts(batch: pa.RecordBatch) -> pa.Table:
    """batch: text, lang, source. lang, source, term, count, docs of a batch; each group has a row of the term '' with its documents."""
    data, at = common.text_buffer(batch.column("text"))
    begin, end, doc = common.words_of(data, at, _TERM_BYTES)
    data = np.concatenate([common.fold_case(data), np.zeros(8, np.uint8)])
    codes, firsts = grouped(data, begin, end)
    group, names = pd.factorize(pd.MultiIndex.from_arrays([batch.column(c).to_pandas() for c in ("lang", "source")]))
    lang, source = (pa.array(names.get_level_values(k), pa.string()) for k in (0, 1))
    # a number for each document and term, whose runs are the term's count in the document
    m = max(len(firsts), 1)
    pairs, times = np.unique(doc * m + codes, return_counts=True)
    cells = group[pairs // m] * m + pairs % m
    order = np.argsort(cells, kind="stable")
    cells, docs = np.unique(cells[order], return_counts=True)
    counts = np.add.reduceat(times[order], np.cumsum(docs) - docs) if len(cells) else times
    terms = _strings(data, begin[firsts], end[firsts]).take(pa.array(cells % m))
    whole = np.bincount(group, minlength=len(names))
    of = np.concatenate([cells // m, np.arange(len(names))])
    terms = pa.concat_arrays([terms, pa.array([""] * len(names), pa.string())])
    counts, docs = np.concatenate([counts, np.zeros(len(names), np.int64)]), np.concatenate([docs, whole])
    return pa.table({"lang": lang.take(pa.array(of)), "source": source.take(pa.array(of)), "term": terms, "count": pa.array(counts, pa.int64()), "docs": pa.array(docs, pa.int64())})


def _combined(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
    return out.rename_columns({"count_sum": "count", "docs_sum": "docs"}).select(["lang", "source", "term", "count", "docs"])


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = settled = 0
    for whole in batches:
        for batch in common.pieces(whole, "text"):
            held.append(term_counts(batch))
            rows += held[-1].num_rows
            if rows > settled + FLUSH_ROWS:
                held = [_combined(held)]
                rows = settled = held[0].num_rows
                if rows > FLUSH_ROWS:
                    yield from held.pop().to_batches(16_384)
                    rows = settled = 0
    if held:
        yield from _combined(held).to_batches(16_384)


def terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs (documents with the term), in partitions by (lang, term); the term '' counts a group's documents."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    out = own.mapInArrow(common.released(_tokenize), "lang string, source string, term string, count long, docs long")
    # one shuffle: what is combined by (lang, source, term) here and by (lang, term) later lies together
    return out.repartition(common.parts(docs.sparkSession), "lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str = "kept") -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)) without rounding, however large the counts."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(19,0))) div cast({total} + {PRIOR} * {kept} as decimal(19,0))").cast("long")


def row_distances(z: np.ndarray, at: np.ndarray, column: np.ndarray, p: np.ndarray, columns: int) -> np.ndarray:
    """Distances (sum of absolute differences) between all rows of a CSR matrix whose entries that aren't stored are z of their row."""
    n = len(z)
    out = np.zeros((n, n), np.int64)
    row = np.repeat(np.arange(n), np.diff(at))
    full = np.flatnonzero(np.diff(at))
    for a in range(n):
        mine = slice(at[a], at[a + 1])
        dense = np.full(columns, z[a])
        dense[column[mine]] = p[mine]
        # as if b stored nothing: a's entries against z of b, by sorted prefix sums, then the columns that neither has
        x = np.sort(p[mine])
        sums = np.concatenate([[0], np.cumsum(x)])
        k = np.searchsorted(x, z)
        total = k * z - sums[k] + (sums[-1] - sums[k]) - (len(x) - k) * z + (columns - len(x)) * np.abs(z[a] - z)
        # and what b's entries change
        if len(full):
            other = dense[column]
            total[full] += np.add.reduceat(np.abs(other - p) - np.abs(other - z[row]), at[:-1][full])
        out[a] = total
    return out


def _block_distances(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """entries: term, source, p of a block. groups: lang, source, z of all the language's groups. lang, source, item, value: the block's part of each distance."""
    names = groups.column("source").to_pylist()
    order = np.argsort(np.array(names, object), kind="stable")
    names = [names[k] for k in order]
    z = groups.column("z").to_numpy()[order]
    row = pd.Categorical(entries.column("source").to_pylist(), categories=names).codes.astype(np.int64)
    column, uniques = pd.factorize(entries.column("term").to_pandas())
    by = np.argsort(row, kind="stable")
    at = np.searchsorted(row[by], np.arange(len(names) + 1))
    d = row_distances(z, at, column[by], entries.column("p").to_numpy()[by], len(uniques))
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    names = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([groups.column("lang")[0].as_py()] * len(a), pa.string()), "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": pa.array(d[a, b], pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Each language keeps the terms that at least least_docs of its documents hold. Part pair: for each group (lang, source) the other sources of the language by
    distance. Part term: the top kept terms that the group has and whose share in the group is above that in the language, by the difference. Null text, lang and
    source are ''; rows that repeat count again; ids are not looked at. A language without kept terms has distances of 0 and no terms; one with a single source
    has no pairs; an empty table has no rows. The pairs are as many as the contract asks for: sources of a language squared.
    """
    spark = docs.sparkSession
    common.tune(spark)
    counted = common.materialize(terms(docs), "terms")
    by_term = counted.where("term != ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).where(F.col("docs") >= least_docs)
    kept = common.materialize(counted.select("lang", "source", "term", "count").join(by_term.select("lang", "term", "lang_count"), ["lang", "term"]), "kept-terms")

    # totals of groups and languages
    groups = counted.where("term = ''").select("lang", "source")
    of_lang = kept.groupBy("lang", "term").agg(F.first("lang_count").alias("c")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("c").alias("lang_total"))
    entries = kept.groupBy("lang").agg(F.count("*").alias("entries"))
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left").join(of_lang, "lang", "left").join(entries, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "lang_total", "entries"])
    groups = groups.withColumn("z", F.when(F.col("kept") > 0, F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({PRIOR} as decimal(19,0))) div cast(nullif(total + {PRIOR} * kept, 0) as decimal(19,0))")).otherwise(F.lit(0)).cast("long"))
    groups = common.materialize(groups.withColumn("blocks", F.expr(f"greatest(1, cast(ceil(entries / {BLOCK_ENTRIES}) as int))")), "groups", narrow=True)
    bounded = F.broadcast(groups) if groups.count() <= SEND_GROUPS else groups
    cells = kept.join(bounded, ["lang", "source"])
    cells = cells.select("lang", "source", "term", "count", "blocks", share("count", "total").alias("p"), share("lang_count", "lang_total").alias("q"))

    blocks = cells.select("lang", F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block"), "term", "source", "p")
    heads = groups.select("lang", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "source", "z")

    parts = blocks.groupBy("lang", "block").cogroup(heads.groupBy("lang", "block")).applyInArrow(_block_distances, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    above = cells.where("count > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs, above = (x.withColumn("rank", rank) for x in (pairs, above))
    columns = ["lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"]
    out = pairs.select(*columns)
    columns[2] = F.lit("term").alias("part")
    return out.unionByName(above.where(F.col("rank") <= top).select(*columns))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


SQL = r"""with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as (select id, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) as term from d),
k as (select lang, term from t group by all having count(distinct id) >= 30),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as c from t join k using (lang, term) group by all),
n as (select lang, source, sum(c) as n from c group by all),
nl as (select lang, sum(c) as n from c group by all),
cl as (select lang, term, sum(c) as c from c group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + cast(1000000000 * (coalesce(c.c, 0) + 5) as hugeint) // cast(coalesce(n.n, 0) + 5 * v.v as hugeint) as p,
    1 + cast(1000000000 * (cl.c + 5) as hugeint) // cast(nl.n + 5 * v.v as hugeint) as q
  from g join k using (lang) join v using (lang) join cl using (lang, term) join nl using (lang) left join n on n.lang = g.lang and n.source = g.source
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
    left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y using (lang, term) where x.source <> y.source group by all) s on s.lang = a.lang and s.source = a.source and s.item = b.source
),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select lang, source, 'term', term, abs(p - q) from p where c > 0 and p > q)
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50"""
