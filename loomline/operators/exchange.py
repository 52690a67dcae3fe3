"""Numbered text for an external translator and back: export, estimate, validation, and a resumable batched map."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as tx
from .dealing import bounded, dealt, in_batches

#: The tag that export files carry; pass another one to read and write files of a tool that has its own.
FORMAT = "numbered-text/1"
BATCH, RETRIES = 20, 3
#: Seconds that a batch waits at most before it is tried again.
LONGEST_PAUSE = 8
#: A provider takes the texts of a batch and returns its reply, as one string.
Provider = Callable[[list[str]], str]


def export(blocks: DataFrame) -> DataFrame:
    """book, i, tag, text: what a translator gets."""
    return blocks.select("book", F.col("seq").alias("i"), "tag", tx.plain_text("frag").alias("text"))


def payload(exported: DataFrame, books: DataFrame, tag: str = FORMAT) -> DataFrame:
    """book, json: the export file of each book. books: book, title, creators, lang, source_file."""
    lists = exported.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("i", "tag", "text"))).alias("blocks"))
    return lists.join(books, "book").select("book", F.to_json(F.struct(F.lit(tag).alias("format"), "source_file", F.col("lang").alias("source_lang"), "title", "creators", "blocks")).alias("json"))


def read_export(files: DataFrame, tag: str = FORMAT) -> DataFrame:
    """files: book, json. One row per block, or one with status not_export where the format tag is another."""
    schema = "format string, source_file string, source_lang string, title string, creators array<string>, blocks array<struct<i: int, tag: string, text: string>>"
    parsed = files.select("book", F.from_json("json", schema).alias("x"))
    ok = F.coalesce(F.col("x.format") == tag, F.lit(False))
    return parsed.select("book", F.when(ok, "ok").otherwise("not_export").alias("status"), F.explode_outer(F.when(ok, F.col("x.blocks"))).alias("b")).select("book", "status", "b.*")


def estimate(exported: DataFrame, batch: int = BATCH) -> DataFrame:
    """book, blocks, chars, requests."""
    n = F.count("*")
    return exported.groupBy("book").agg(n.alias("blocks"), F.sum(F.length("text")).alias("chars"), F.expr(f"(count(*) + {batch - 1}) div {batch}").alias("requests"))


# Under which names an item of a translation has its text, and a file its language.
ITEM_KEYS, LANG_KEYS = ("text", "translation", "target"), ("target_lang", "lang")
#: What ends a line: all that Python's splitlines() knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def read_translations(files: DataFrame) -> DataFrame:
    """files: book, text. book, status (ok or bad_translation), i, text, target_lang (if the file names it): items count by their place, whatever number they carry.

    What parses as JSON is JSON: a list, or an object with the list as blocks. Its items are strings, or objects with a string under one of ITEM_KEYS. Anything else is
    a line for each block; blank ones don't count. A file of no items has no rows. It is all expressions over variants: no Python worker sees a file.
    """

    def is_a(v: Column, kind: str) -> Column:
        return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))

    def text_of(item: Column) -> Column:
        under = [F.when(is_a(part, "STRING"), F.try_variant_get(part, "$", "string")) for part in (F.try_variant_get(item, f"$.{k}", "variant") for k in ITEM_KEYS)]
        return F.when(is_a(item, "STRING"), F.try_variant_get(item, "$", "string")).when(is_a(item, "OBJECT"), F.coalesce(*under))

    own = files.select("book", F.coalesce("text", F.lit("")).alias("raw")).withColumn("v", F.try_parse_json("raw"))
    listed = F.when(is_a(F.col("v"), "ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(is_a(F.col("v"), "OBJECT"), F.try_variant_get("v", "$.blocks", "array<variant>"))
    lines = F.filter(F.transform(F.split("raw", LINE_END), tx.trimmed), lambda x: x != "")
    items = F.when(F.col("v").isNull(), lines).otherwise(F.transform(listed, text_of))
    lang = F.coalesce(*[F.nullif(F.try_variant_get("v", f"$.{k}", "string"), F.lit("")) for k in LANG_KEYS])
    own = own.select("book", items.alias("items"), F.when(is_a(F.col("v"), "OBJECT"), lang).alias("target_lang"))
    fine = F.col("items").isNotNull() & ~F.exists("items", lambda x: x.isNull())
    good = own.where(fine).select("book", F.lit("ok").alias("status"), F.posexplode("items").alias("i", "text"), "target_lang")
    bad = own.where(~F.coalesce(fine, F.lit(False))).select("book", F.lit("bad_translation").alias("status"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("text"), "target_lang")
    return good.unionByName(bad)


def validate(exported: DataFrame, translated: DataFrame) -> DataFrame:
    """book, want, got, empty (the first ten empty items), status: ok, wrong_count or empty_items."""
    want = exported.groupBy("book").agg(F.count("*").alias("want"))
    blank = F.length(tx.trimmed(F.coalesce("text", F.lit("")))) == 0
    got = translated.where(F.col("i").isNotNull()).groupBy("book").agg(F.count("*").alias("got"), F.slice(F.array_sort(F.collect_list(F.when(blank, F.col("i")))), 1, 10).alias("empty"))
    both = want.join(got, "book", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return both.withColumn("status", F.when(F.col("got") != F.col("want"), "wrong_count").when(F.size(F.coalesce("empty", F.array())) > 0, "empty_items").otherwise("ok"))


def todo(exported: DataFrame, cache: DataFrame | None, batch: int = BATCH) -> DataFrame:
    """Blocks that the cache (book, i, text) lacks, with the number of the batch of the book that each is in."""
    left = exported.join(cache.select("book", "i"), ["book", "i"], "left_anti") if cache is not None else exported
    return left.withColumn("batch", F.expr(f"(row_number() over (partition by book order by i) - 1) div {batch}").cast("int"))


def translate_batch(texts: list[str], provider: Provider, retries: int = RETRIES, pause: Callable[[float], None] = time.sleep) -> list[str | None]:
    """Tries a batch some times, waiting longer after each failure, then its halves, down to single texts; None for a text that can't be had."""
    for attempt in range(retries):
        try:
            return list(tx.parse_reply(provider(texts), len(texts)))
        except (ValueError, OSError):
            pause(min(2**attempt, LONGEST_PAUSE))
    if len(texts) == 1:
        return [None]
    half = len(texts) // 2
    return translate_batch(texts[:half], provider, retries, pause) + translate_batch(texts[half:], provider, retries, pause)


def requests(left: DataFrame) -> DataFrame:
    """todo() as one row for each request: book, batch, items (i and text, in order; as many as a batch has)."""
    return left.groupBy("book", "batch").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("items"))


def translate(
    exported: DataFrame, provider: Provider, cache: DataFrame | None = None, batch: int = BATCH, retries: int = RETRIES, at_once: int = 1, pause: Callable[[float], None] = time.sleep, progress: Accumulator | None = None
) -> DataFrame:
    """book, i, text, status (done or failed) of the blocks that the cache lacks. A task has at_once requests under way at most; progress, if given, counts the blocks
    that were asked for. streaming.translation keeps what is done, so that a later run asks for the rest only."""

    schema = "book string, i int, text string, status string"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def ask(request: tuple) -> list[tuple]:
        book, items = request
        out = translate_batch([x["text"] for x in items], provider, retries, pause)
        if progress is not None:
            progress.add(len(out))
        return [(book, x["i"], text, "failed" if text is None else "done") for x, text in zip(items, out)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                waiting = list(zip(b.column("book").to_pylist(), b.column("items").to_pylist()))
                for k in range(0, len(waiting), at_once):  # what is done goes on before more is asked for
                    for done in pool.map(ask, waiting[k : k + at_once]):
                        yield from done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), arrow, lambda row: len(row[2] or ""))

    bounded(exported.sparkSession)
    asked = dealt(requests(todo(exported, cache, batch)), "book", "batch").select("book", "items")
    return asked.mapInArrow(run, schema)


def in_order(exported: DataFrame, translated: DataFrame) -> DataFrame:
    """book, i, tag, text with the translation in each block's place."""
    return exported.drop("text").join(translated.select("book", "i", "text"), ["book", "i"], "left")


def built(exported: DataFrame, translated: DataFrame) -> DataFrame:
    """Blocks (book, seq, tag, frag) of the translated book: headings as h2, all else as p, text escaped."""
    own = in_order(exported, translated)
    return own.select("book", F.col("i").alias("seq"), F.when(tx.is_heading("tag"), "h2").otherwise("p").alias("tag"), tx.escaped("text").alias("frag"))
