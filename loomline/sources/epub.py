"""EPUB archives as rows: entries, packages, spine documents, fingerprints. One bad book is a status, not a failed job. plans.books writes them."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as tx
from ..operators import extract
from ..operators.dealing import in_batches
from . import zips

#: Archives larger than this are refused before they are read into a task.
MAX_BYTES = 400 << 20
PACKAGE = (
    "path string, status string, root string, title string, creators array<string>, languages array<string>, cover binary, cover_type string, "
    "spine array<struct<position: int, href: string, html: string>>"
)
#: A row for each document in a book's order, with what the package says; the cover is in the first only. A book without documents has a row without a position.
DOCUMENTS = "path string, status string, root string, title string, creators array<string>, languages array<string>, cover binary, position int, href string, html string"
MAX_DEPTH = 3
#: Bytes of archives that one task reads, or one archive.
BYTES_PER_TASK = 16 << 20


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of each file; one that is too large has no content, and isn't read."""
    files = spark.read.format("binaryFile").load(path)
    small, large = files.where(F.col("length") <= MAX_BYTES), files.where(F.col("length") > MAX_BYTES)
    return small.select("path", "length", "content").unionByName(large.select("path", "length", F.lit(None).cast("binary").alias("content")))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def book_root(names: list[str]) -> str:
    """The folder that holds META-INF/container.xml: the archive's own, else the shallowest within three levels. Keys of failures are raised as KeyError."""
    roots = []
    for n in names:
        if n.endswith("META-INF/container.xml"):
            folder = n[: -len("META-INF/container.xml")]
            parts = folder.split("/")[:-1]
            if len(parts) <= MAX_DEPTH and not any(p == "__MACOSX" or p.startswith(".") for p in parts):
                roots.append(folder)
    if "" in roots:
        return ""
    if not roots:
        raise KeyError("no_book_in")
    depth = min(r.count("/") for r in roots)
    least = [r for r in roots if r.count("/") == depth]
    if len(least) > 1:
        raise KeyError("many_books")
    return least[0]


def read_book(path: str, open_: Callable[[], BinaryIO] | None) -> Iterator[dict]:
    """Rows of DOCUMENTS of one archive, one document at a time. Status ok, too_big, missing_file, not_epub, no_book_in, many_books, damaged_index or no_order."""
    row = {"path": path, "status": "ok", "root": None, "title": None, "creators": [], "languages": [], "cover": None, "position": None, "href": None, "html": None}
    try:
        if open_ is None:
            raise KeyError("too_big")
        try:
            archive = zipfile.ZipFile(open_())
        except zipfile.BadZipFile:
            raise KeyError("not_epub") from None
        names = archive.namelist()
        root = book_root(names)
        try:
            container = ElementTree.fromstring(archive.read(root + "META-INF/container.xml"))
            opf = root + next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile" and x.get("full-path"))
            package = ElementTree.fromstring(archive.read(opf))
        except (ElementTree.ParseError, StopIteration, KeyError):
            raise KeyError("damaged_index") from None
        base = posixpath.dirname(opf)
        items, spine, meta = {}, None, {"title": [], "creator": [], "language": []}
        cover_id = None
        for x in package.iter():
            name = _local(x.tag)
            if name == "item" and x.get("id"):
                items[x.get("id")] = (posixpath.normpath(posixpath.join(base, x.get("href", ""))), x.get("media-type", ""), set(x.get("properties", "").split()))
            elif name == "spine":
                spine = [r.get("idref") for r in x if _local(r.tag) == "itemref"]
            elif name in meta and (x.text or "").strip():
                meta[name].append(x.text.strip())
            elif name == "meta" and x.get("name") == "cover":
                cover_id = x.get("content")
        if spine is None:
            raise KeyError("no_order")
        have = set(names)
        documents = [items[idref][0] for idref in spine if idref in items and "html" in items[idref][1].lower() and items[idref][0] in have]
        cover = next((h for h, _, p in items.values() if "cover-image" in p), items.get(cover_id, (None,))[0])
        if cover in have:
            row["cover"] = archive.read(cover)
        stem = posixpath.splitext(posixpath.basename(path))[0]
        row |= {"root": root, "title": (meta["title"] or [stem])[0], "creators": meta["creator"], "languages": meta["language"] or ["und"]}
    except KeyError as e:
        row["status"], documents = e.args[0], []
    for position, href in enumerate(documents):
        yield row | {"position": position, "href": href, "html": archive.read(href).decode("utf-8", "replace")}
        row["cover"] = None
    if not documents:
        yield row


def read_package(path: str, content: bytes | None) -> dict:
    """One row of PACKAGE, with read_book()'s status."""
    rows = list(read_book(path, None if content is None else lambda: io.BytesIO(content)))
    spine = [{k: x[k] for k in ("position", "href", "html")} for x in rows if x["position"] is not None]
    return {k: rows[0].get(k) for k in ("path", "status", "root", "title", "creators", "languages", "cover", "cover_type")} | {"spine": spine}


class _BookReader(zips.ListingReader):
    def __init__(self, path: str, per_task: int, most: int, schema: pa.Schema) -> None:
        super().__init__(path, per_task, most)
        self.schema = schema

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = zips.file_system(partition.base)

        def rows() -> Iterator[tuple]:
            for path, _ in partition.files:
                with ExitStack() as files:
                    for row in read_book(path, lambda: files.enter_context(zips.open_seekable(fs, path))):
                        yield tuple(row.values())

        return in_batches(rows(), self.schema, lambda row: len(row[-1] or "") + len(row[6] or b""))


class BookSource(DataSource):
    """Options: path, a file or a folder; filesPerTask, bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BookReader(self.options["path"], int(self.options.get("filespertask", zips.FILES_PER_TASK)), int(self.options.get("bytespertask", BYTES_PER_TASK)), to_arrow_schema(schema))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """DOCUMENTS of the archives at or below path. Tasks have many small archives, and take a large one document by document, so that its size is no limit. As zips, this goes
    through the file systems that Arrow knows; archives() and packages() read whole files through Spark."""
    spark.dataSource.register(BookSource)
    return spark.read.format("books").load(path)


def blocks_of(books: DataFrame) -> DataFrame:
    """Blocks of documents() in reading order, as blocks() has them of packages()."""
    return extract.blocks(books.where("position is not null").select(F.col("path").alias("book"), "position", "html", F.col("languages")[0].alias("lang")))


def packages(files: DataFrame) -> DataFrame:
    """files: path, content. One row of PACKAGE per archive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):  # one book at a time
                yield pd.DataFrame([read_package(path, content)])

    out = files.select("path", "content").mapInPandas(run, PACKAGE)
    return out.withColumn("cover_type", F.when(F.col("cover").isNotNull(), tx.cover_type("cover")))


def blocks(books: DataFrame) -> DataFrame:
    """Blocks of packages() in reading order; book is the path, the default language the first that the package declares."""
    docs = books.where("status = 'ok'").select(F.col("path").alias("book"), F.col("languages")[0].alias("lang"), F.explode("spine").alias("d"))
    return extract.blocks(docs.select("book", F.col("d.position").alias("position"), F.col("d.html").alias("html"), "lang"))


def entries(files: DataFrame) -> DataFrame:
    """zips.LISTING of files (path, content) that are in memory; zips.read() lists files in place."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for path, content in zip(f.column("path").to_pylist(), f.column("content")):
                content = content.as_py() or b""
                yield zips.batch(list(zips.listing(path, len(content), lambda content=content: io.BytesIO(content))))

    return files.select("path", "content").mapInArrow(run, zips.LISTING)


def fingerprint(listed: DataFrame) -> DataFrame:
    """listed: zips.LISTING. An archive's shape without its text: size, whether it is one and what was wrong if not, its type, counts, flags, the ten commonest extensions ((none) for members without), up to 3 packages, and 40 names made anonymous."""
    name = F.col("name")
    leaf = F.ltrim(F.substring_index(name, "/", -1), F.lit("."))  # dots that begin a name begin no extension
    extension = F.coalesce(F.nullif(F.lower(F.regexp_extract(leaf, r"(\.[^.]*)$", 1)), F.lit("")), F.lit("(none)"))

    def first(n: int, rows) -> F.Column:  # noqa: ANN001
        return F.slice(F.array_sort(rows), 1, n)

    def held(keep) -> F.Column:  # noqa: ANN001
        return F.collect_list(F.when(keep, F.struct("position", "name")))

    # by extension, then by archive, so that the listing is gone through once
    of = listed.groupBy("path", F.when(name.isNotNull(), extension).alias("ext")).agg(
        F.max("bytes").alias("bytes"), F.bool_or("is_zip").alias("is_zip"), F.bool_or("bad_zip").alias("bad_zip"), F.max("inspect_error").alias("inspect_error"), F.max("mimetype").alias("mimetype"), F.count("name").alias("n"), F.min("position").alias("first"),
        F.bool_or(name == "META-INF/container.xml").alias("has_container"), F.bool_or(name == "mimetype").alias("has_mimetype"), F.bool_or("encrypted").alias("encrypted"),
        first(3, held(F.endswith(name, F.lit(".opf")))).alias("opf"), first(40, held(name.isNotNull())).alias("sample"),
    )
    top = F.collect_list(F.when(F.col("ext").isNotNull(), F.struct((-F.col("n")).alias("k"), "first", "ext", "n")))
    return of.groupBy("path").agg(
        F.max("bytes").alias("bytes"), F.bool_or("is_zip").alias("is_zip"), F.bool_or("bad_zip").alias("bad_zip"), F.max("inspect_error").alias("inspect_error"), F.max("mimetype").alias("mimetype"), F.sum("n").alias("entries"), F.coalesce(F.bool_or("has_container"), F.lit(False)).alias("has_container"),
        F.coalesce(F.bool_or("has_mimetype"), F.lit(False)).alias("has_mimetype"), F.bool_or("encrypted").alias("encrypted"),
        F.transform(first(3, F.flatten(F.collect_list("opf"))), lambda x: x["name"]).alias("opf"), F.transform(first(40, F.flatten(F.collect_list("sample"))), lambda x: tx.anonymous_name(x["name"])).alias("sample_entries"),
        first(10, top).alias("t"),
    ).withColumn("by_extension", F.when(F.size("t") > 0, F.map_from_entries(F.transform("t", lambda x: F.struct(x["ext"], x["n"]))))).drop("t")
