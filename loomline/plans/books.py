"""Books out of the engine: chapters and metadata as the members of EPUB 3 archives, and the merge, import and split of whole books.

Every member is a row that expressions make; sources.zips streams the rows into archives. Only tables of contents are gathered per book.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chapters, exchange, languages, script
from ..operators.tables import kept
from ..sources import epub
from . import merge

BOOK = "book string, title string, creators array<string>, languages array<string>, publisher string, description string, cover binary"
# What the parts of a package are called, and the namespace of identifiers that are made from urls.
PACKAGE_TYPE, CONTAINER = "application/epub+zip", "META-INF/container.xml"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
MODIFIED = "2026-01-01T00:00:00Z"
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg"}

PLAIN_STYLE = {"mono.css": "body { margin: 0 5%; line-height: 1.6; }\np { margin: 0 0 0.9em; }\nh2 { text-align: center; margin: 2em 0 1.5em; }\n"}
PAIRED_STYLE = """body {{ margin: 0 5%; line-height: 1.55; }}
.pair {{ margin-bottom: 1.3em; }}
.pair.sec {{ margin-top: 2em; }}
.pair p, .pair h2 {{ margin: 0 0 0.25em; text-indent: 0; }}
.pair .b {{ font-size: 95%; }}
.pair.unsure {{ border-left: 2px dotted; padding-left: 0.5em; }}
.toolbar {{ text-align: center; }}
a.peek, a.toggle-all {{ color: inherit; text-decoration: none; }}
.blurred {{ filter: blur({blur}); }}
.blurred:target, .blurred.shown, body.all-shown .blurred {{ filter: none; }}
img {{ max-width: 100%; }}
"""
PAIRED_SCRIPT = """document.addEventListener("click", function (event) {
  var all = event.target.closest(".toggle-all"), one = event.target.closest(".blurred");
  if (all) { document.body.classList.toggle("all-shown"); event.preventDefault(); }
  else if (one) { one.classList.toggle("shown"); event.preventDefault(); }
});
"""


def identifier(name: Column) -> Column:
    """The version 5 UUID of a name in the namespace of urls."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda k, n: F.substring(digest, k, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def _all(of: Column, item) -> Column:  # noqa: ANN001
    return F.array_join(F.transform(F.coalesce(of, F.array().cast("array<string>")) if isinstance(of, str) else of, item), "\n")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def page(title: Column, body: Column, styles: Sequence[str] = (), scripts: Sequence[str] = ()) -> Column:
    """An XHTML document; body is markup."""
    head = "".join(f'<link rel="stylesheet" type="text/css" href="../css/{x}"/>' for x in styles) + "".join(f'<script type="text/javascript" src="../js/{x}"></script>' for x in scripts)
    begin = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><meta charset="utf-8"/><title>'
    return _text(begin, tx.escaped(title), f"</title>{head}</head>\n<body>\n", body, "\n</body></html>\n")


def members(pages: DataFrame, books: DataFrame, styles: Mapping[str, str] | None = None, scripts: Mapping[str, str] | None = None) -> DataFrame:
    """zips.MEMBERS of EPUB 3 archives. pages: book, chapter, title, page (a whole XHTML document), scripted (whether it runs scripts). books: BOOK; book is the
    archive's name, of which its identifier is made. The type comes first and uncompressed, then container, package, navigation in both forms, style sheets, scripts,
    the cover and its page, and the chapters in order. Without languages a book's is und; without pages it has none."""
    styles, scripts = styles or {}, scripts or {}
    entry = F.struct("chapter", tx.chapter_id("chapter").alias("cid"), "title", "scripted")
    toc = pages.groupBy("book").agg(F.array_sort(F.collect_list(entry)).alias("toc"))
    one = books.join(toc, "book", "left")
    has_cover = F.col("cover").isNotNull() & (F.length("cover") > 0)
    cover_type = tx.cover_type("cover")
    image = _text("cover.", F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), cover_type))
    none = F.array().cast("array<struct<chapter: int, cid: string, title: string, scripted: boolean>>")
    front = F.array(F.struct(F.lit(0).alias("chapter"), F.lit("cover").alias("cid"), F.lit("Cover").alias("title"), F.lit(False).alias("scripted")))
    one = one.withColumn("toc", F.coalesce(F.col("toc").cast(none_type := "array<struct<chapter: int, cid: string, title: string, scripted: boolean>>"), none))
    one = one.withColumn("spine", F.concat(F.when(has_cover, front.cast(none_type)).otherwise(none), "toc")).withColumn("uid", identifier(F.col("book")))
    esc = lambda c: tx.escaped(c, quotes=True)
    langs = F.when(F.size(F.coalesce("languages", F.array().cast("array<string>"))) > 0, F.col("languages")).otherwise(F.array(F.lit("und")))
    of = lambda c, tag: F.when(F.length(F.col(c)) > 0, _text(f"<dc:{tag}>", esc(c), f"</dc:{tag}>")).otherwise("")
    metadata = _text(
        '<dc:identifier id="uid">urn:uuid:', F.col("uid"), "</dc:identifier><dc:title>", esc(F.coalesce("title", F.lit(""))), "</dc:title>\n",
        F.array_join(F.transform(F.coalesce("creators", F.array().cast("array<string>")), lambda x: _text("<dc:creator>", esc(x), "</dc:creator>")), ""), F.array_join(F.transform(langs, lambda x: _text("<dc:language>", esc(x), "</dc:language>")), ""),
        of("publisher", "publisher"), of("description", "description"), f'<meta property="dcterms:modified">{MODIFIED}</meta>', F.when(has_cover, '<meta name="cover" content="cover-image"/>').otherwise(""),
    )
    fixed = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    fixed += "".join(f'<item id="css-{x}" href="css/{x}" media-type="text/css"/>' for x in styles) + "".join(f'<item id="js-{x}" href="js/{x}" media-type="text/javascript"/>' for x in scripts)
    covers = F.when(has_cover, _text('<item id="cover-image" href="images/', image, '" media-type="', cover_type, '" properties="cover-image"/><item id="cover" href="text/cover.xhtml" media-type="application/xhtml+xml"/>')).otherwise("")
    items = _all(F.col("toc"), lambda x: _text('<item id="', x["cid"], '" href="text/', x["cid"], '.xhtml" media-type="application/xhtml+xml"', F.when(x["scripted"], ' properties="scripted"').otherwise(""), "/>"))
    opf = _text(
        '<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">', metadata,
        f"</metadata>\n<manifest>{fixed}", covers, "\n", items, '</manifest>\n<spine toc="ncx">', _all(F.col("spine"), lambda x: _text('<itemref idref="', x["cid"], '"/>')), "</spine></package>\n",
    )
    links = _all(F.col("spine"), lambda x: _text('<li><a href="text/', x["cid"], '.xhtml">', esc(x["title"]), "</a></li>"))
    nav = _text('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><meta charset="utf-8"/><title>Contents</title></head><body><nav epub:type="toc"><ol>\n', links, "\n</ol></nav></body></html>\n")
    points = F.array_join(F.transform("spine", lambda x, k: _text('<navPoint id="', x["cid"], '" playOrder="', (k + 1).cast("string"), '"><navLabel><text>', esc(x["title"]), '</text></navLabel><content src="text/', x["cid"], '.xhtml"/></navPoint>')), "\n")
    ncx = _text('<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="urn:uuid:', F.col("uid"), '"/></head><docTitle><text>', esc(F.coalesce("title", F.lit(""))), "</text></docTitle><navMap>\n", points, "\n</navMap></ncx>\n")
    container = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'
    front_page = page(F.lit("Cover"), _text('<div><img src="../images/', image, '" alt="cover"/></div>'))

    def member(position: int, name: Column | str, content: Column | str, stored: bool = False) -> Column:
        body = F.encode(F.lit(content) if isinstance(content, str) else content, "UTF-8")
        return F.struct(F.lit(position).alias("position"), (F.lit(name) if isinstance(name, str) else name).alias("name"), body.alias("content"), F.lit(stored).alias("stored"))

    heads = [member(0, "mimetype", PACKAGE_TYPE, True), member(1, CONTAINER, container), member(2, "OEBPS/content.opf", opf), member(3, "OEBPS/nav.xhtml", nav), member(4, "OEBPS/toc.ncx", ncx)]
    heads += [member(k, f"OEBPS/{folder}/{name}", content) for k, (folder, name, content) in enumerate([("css", *x) for x in styles.items()] + [("js", *x) for x in scripts.items()], 5)]
    pictures = [F.struct(F.lit(98).alias("position"), _text("OEBPS/images/", image).alias("name"), F.col("cover").alias("content"), F.lit(False).alias("stored")), member(99, "OEBPS/text/cover.xhtml", front_page)]
    own = one.select(F.col("book").alias("archive"), F.explode(F.concat(F.array(*heads), F.when(has_cover, F.array(*pictures)).otherwise(F.array().cast("array<struct<position: int, name: string, content: binary, stored: boolean>>")))).alias("m")).select("archive", "m.*")
    bodies = pages.join(books.select("book"), "book", "left_semi")
    bodies = bodies.select(F.col("book").alias("archive"), (F.col("chapter") + 99).cast("int").alias("position"), _text("OEBPS/text/", tx.chapter_id("chapter"), ".xhtml").alias("name"), F.encode("page", "UTF-8").alias("content"), F.lit(False).alias("stored"))
    return own.unionByName(bodies)


def plain_pages(blocks: DataFrame, styles: Sequence[str] = tuple(PLAIN_STYLE)) -> DataFrame:
    """pages of books in one language. blocks: book, seq, tag, frag, lang. Headings are h2 and begin chapters, all else is p, each with its language."""
    own = chapters.of_blocks(languages.rendered(blocks).withColumn("given", F.col("tag")), "book")
    names = chapters.titles(own, "book").select("book", "chapter", tx.chapter_title("title", "chapter").alias("title"))
    lang = tx.escaped(F.coalesce("lang", F.lit("")), quotes=True)
    cell = _text("<", F.col("tag"), ' lang="', lang, '" xml:lang="', lang, '">', F.col("frag"), "</", F.col("tag"), ">")
    bodies = own.select("book", "chapter", "seq", cell.alias("cell")).groupBy("book", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "cell"))), lambda x: x["cell"]), "\n").alias("body"))
    pages = bodies.join(names, ["book", "chapter"])
    section = _text('<section epub:type="chapter" class="chap">\n', F.col("body"), "\n</section>")
    return pages.select("book", F.col("chapter").cast("int").alias("chapter"), "title", page(F.col("title"), section, styles).alias("page"), F.lit(False).alias("scripted"))


class Books(NamedTuple):
    """members: zips.MEMBERS of the books; statistics: counts by chapter; status: a row for each book that was asked for, ok or why there is none."""

    members: DataFrame
    statistics: DataFrame
    status: DataFrame


def first_seen(a: Column, b: Column) -> Column:
    """What two lists hold, each once, in the order in which it comes first."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def merged(
    a: DataFrame, b: DataFrame, blur: str = merge.BLUR, blur_side: str = merge.BLUR_SIDE, convert_side: str | None = None, tables: Sequence[Mapping[str, str]] | None = None,
    title: str | None = None, authors: list[str] | None = None, toggle: str = merge.TOGGLE, ceiling: int | None = None,
) -> Books:
    """The merge of pairs of books. a, b: pair_id and epub.PACKAGE. pair_id is the archive's name.

    Blocks are aligned, beads that were nearly paired otherwise are marked, chapters are cut at headings, and paired blocks of blur_side (a, b or none) are veiled.
    The title is both titles, creators are those of both in the order first seen, the languages are the first of each side, the cover is that of the first side that
    has one; title and authors replace them. convert_side's text is converted by tables; asked for without any, no book is made. Status: ok, an error of either
    side's archive, no_text, no_opencc, or too_big where a ceiling is given and a pair exceeds it.
    """
    if blur_side not in ("a", "b", "none"):
        raise ValueError(f"{blur_side!r} is no side")
    sides = {}
    for name, books in (("a", a), ("b", b)):
        parsed = epub.blocks(books.withColumn("path", F.col("pair_id"))).withColumnRenamed("book", "pair_id")
        if convert_side == name and tables:
            parsed = parsed.withColumn("frag", script.converted("frag", tables))
        sides[name] = kept(parsed, f"blocks-{name}")
    # as many rows as pairs, with neither texts nor covers
    brief = [x.select("pair_id", F.col("status").alias(f"status_{s}"), F.col("title").alias(f"title_{s}"), F.col("creators").alias(f"creators_{s}"), F.col("languages").alias(f"languages_{s}"), F.col("cover").alias(f"cover_{s}")) for s, x in (("a", a), ("b", b))]
    pairs = brief[0].join(brief[1], "pair_id")
    beads = merge.merged(sides["a"], sides["b"], ceiling)
    have = [x.select("pair_id").distinct().withColumn(f"has_{s}", F.lit(True)) for s, x in sides.items()]
    aligned = beads.select("pair_id").distinct().withColumn("has_beads", F.lit(True))
    state = pairs.join(have[0], "pair_id", "left").join(have[1], "pair_id", "left").join(aligned, "pair_id", "left")
    refused = F.lit(convert_side is not None and not tables)
    status = (
        F.when(F.col("status_a") != "ok", F.col("status_a")).when(F.col("status_b") != "ok", F.col("status_b")).when(F.col("has_a").isNull() | F.col("has_b").isNull(), "no_text")
        .when(refused, "no_opencc").when(F.col("has_beads").isNull(), "too_big").otherwise("ok")
    )
    state = state.withColumn("status", status)
    lang = lambda s: F.coalesce(F.get(f"languages_{s}", F.lit(0)), F.lit("und"))
    both = F.array_join(F.filter(F.array("title_a", "title_b"), lambda t: F.length(t) > 0), " / ")
    creators = first_seen(F.col("creators_a"), F.col("creators_b"))
    books = state.where("status = 'ok'").select(
        F.col("pair_id").alias("book"), (F.lit(title) if title else both).alias("title"), (F.array(*map(F.lit, authors)) if authors else creators).alias("creators"),
        F.array(lang("a"), lang("b")).alias("languages"), F.lit(None).cast("string").alias("publisher"),
        _text("Two languages side by side (", lang("a"), ", ", lang("b"), "), aligned by machine.").alias("description"), F.coalesce("cover_a", "cover_b").alias("cover"),
    )
    shown = kept(merge.rendered(beads, sides["a"], sides["b"], blur_side), "chapters")
    styles, scripts = {"bilingual.css": PAIRED_STYLE.format(blur=blur)}, {"peek.js": PAIRED_SCRIPT}
    bar = _text('<p class="toolbar" data-nocontent="1"><a class="toggle-all" href="#">', tx.escaped(F.lit(toggle)), "</a></p>\n")
    section = _text(F.when(F.col("veiled"), _text('<section epub:type="chapter" class="chap">\n', bar)).otherwise('<section epub:type="chapter" class="chap noblur">\n'), F.col("body"), "\n</section>")
    pages = shown.select(F.col("pair_id").alias("book"), F.col("chapter").cast("int").alias("chapter"), "title", page(F.col("title"), section, tuple(styles), tuple(scripts)).alias("page"), F.lit(True).alias("scripted"))
    return Books(members(pages, books, styles, scripts), merge.statistics(beads), state.select("pair_id", "status"))


def imported(exported: DataFrame, translated: DataFrame, books: DataFrame, lang: str | None = None, title: str | None = None) -> Books:
    """Books in another language out of exported blocks and their translation. books: book, title, creators, lang and, if the translation's file names it, target_lang.

    The language is the one given, else the file's, else und; the title is the source's with the language. A translation that doesn't line up makes no book; its status is
    that of exchange.validate().
    """
    checked = kept(exchange.validate(exported, translated).select("book", "status"), "checked")
    fine = checked.where("status = 'ok'").select("book")
    to = F.lit(lang) if lang else F.coalesce(F.nullif(F.col("target_lang"), F.lit("")), F.lit("und")) if "target_lang" in books.columns else F.lit("und")
    own = books.join(fine, "book", "left_semi").withColumn("to", to)
    blocks = exchange.built(exported, translated).join(own.select("book", F.col("to").alias("lang")), "book")
    untitled = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled"))
    meta = own.select(
        "book", (F.lit(title) if title else _text(untitled, " (", F.col("to"), ")")).alias("title"), "creators", F.array("to").alias("languages"), F.lit(None).cast("string").alias("publisher"),
        _text("A machine's translation from ", F.coalesce("lang", F.lit("?")), ".").alias("description"), F.lit(None).cast("binary").alias("cover"),
    )
    pages = kept(plain_pages(blocks), "pages")
    counts = pages.groupBy("book").agg(F.count("*").alias("chapters"))
    return Books(members(pages, meta, PLAIN_STYLE), counts, checked)


def split(books: DataFrame, langs: list[str] | None = None) -> Books:
    """A book in each language of books (epub.PACKAGE); the archive's name is a slug of the path's last part with the language. Status: ok, the archive's, or no_text."""
    blocks = kept(epub.blocks(books), "blocks")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    parts = languages.split(blocks, langs).withColumnRenamed("book", "path")
    name = _text(tx.slug(stem), ".", F.col("lang"), ".epub")
    kinds = parts.select("path", "lang").distinct().join(books.select("path", "title", "creators", "cover"), "path")
    meta = kinds.select(
        name.alias("book"), _text(F.col("title"), " (", F.col("lang"), ")").alias("title"), "creators", F.array("lang").alias("languages"), F.lit(None).cast("string").alias("publisher"),
        _text("The ", F.col("lang"), " part of a book in several languages.").alias("description"), "cover",
    )
    pages = kept(plain_pages(parts.select(name.alias("book"), "seq", "tag", "frag", "lang")), "pages")
    has = blocks.select(F.col("book").alias("path")).distinct().withColumn("has", F.lit(True))
    status = books.select("path", "status").join(has, "path", "left").select("path", F.when(F.col("status") != "ok", F.col("status")).when(F.col("has").isNull(), "no_text").otherwise("ok").alias("status"))
    return Books(members(pages, meta, PLAIN_STYLE), pages.groupBy("book").agg(F.count("*").alias("chapters")), status)
