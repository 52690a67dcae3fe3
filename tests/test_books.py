"""Books out of the engine: archives written and listed, merged, imported and split books read back."""

import base64
import io
import random
import tracemalloc
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as tx
from loomline.operators import exchange, script
from loomline.plans import books, catalog
from loomline.sources import epub, zips

PNG = base64.b64decode(catalog.PIXEL)
EN = [("h1", "Chapter One: The Beginning"), ("p", "It was a bright cold day in the town."), ("p", "Nobody had asked the <i>river</i>."), ("h1", "Chapter Two"), ("p", "Later on the bells of the church rang out over the roofs."), ("p", "The end &amp; more.")]
FR = [("h1", "Chapitre un : le début"), ("p", "C'était une journée froide dans la ville."), ("p", "Personne n'avait demandé à la <i>rivière</i>."), ("h1", "Chapitre deux"), ("p", "Plus tard les cloches de l'église sonnaient au-dessus des toits."), ("p", "La fin &amp; plus.")]


def package(spark, rows, title, creators, lang, cover=None, status="ok", pair="bi.epub"):
    html = "<body>" + "".join(f"<{t}>{x}</{t}>" for t, x in rows) + "</body>"
    spine = [(0, "a.xhtml", html)] if rows is not None else []
    return spark.createDataFrame([(pair, f"/in/{title}.epub", status, title, creators, [lang], cover, spine)], f"pair_id string, {epub.PACKAGE.replace('root string, ', '').replace('cover_type string, ', '')}")


def written(made, path, mode="append"):
    zips.write(made.members, str(path), mode)
    return path


def chapter(path, name="OEBPS/text/ch001.xhtml"):
    with zipfile.ZipFile(path) as z:
        return z.read(name).decode()


@pytest.fixture(scope="module")
def pair(spark):
    return package(spark, EN, "The Invented Town", ["Ann", "Bo"], "en"), package(spark, FR, "La Ville Inventée", ["Bo", "Cy"], "fr", PNG)


@pytest.fixture(scope="module")
def merged(spark, pair, tmp_path_factory):
    made = books.merged(*pair, blur="0.9em")
    return made, written(made, tmp_path_factory.mktemp("merged")) / "bi.epub"


def test_a_merged_book_is_an_archive_as_readers_want_it(merged):
    made, path = merged
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        assert names[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and z.read("mimetype") == b"application/epub+zip"
        assert names[1:5] == ["META-INF/container.xml", "OEBPS/content.opf", "OEBPS/nav.xhtml", "OEBPS/toc.ncx"] and {"OEBPS/css/bilingual.css", "OEBPS/js/peek.js", "OEBPS/images/cover.png", "OEBPS/text/cover.xhtml"} < set(names)
        opf, css = z.read("OEBPS/content.opf").decode(), z.read("OEBPS/css/bilingual.css").decode()
        assert z.read("OEBPS/images/cover.png") == PNG and "../images/cover.png" in z.read("OEBPS/text/cover.xhtml").decode()
        for name in names:
            if name.endswith((".xhtml", ".opf", ".ncx", ".xml")):
                __import__("xml.etree.ElementTree").etree.ElementTree.fromstring(z.read(name))
    assert "<dc:title>The Invented Town / La Ville Inventée</dc:title>" in opf and "<dc:language>en</dc:language><dc:language>fr</dc:language>" in opf
    assert "<dc:creator>Ann</dc:creator><dc:creator>Bo</dc:creator><dc:creator>Cy</dc:creator>" in opf  # in the order first seen
    assert 'media-type="image/png"' in opf and "cover.jpg" not in opf and 'properties="scripted"' in opf and f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'bi.epub')}" in opf
    assert "blur(0.9em)" in css and "100%;" in css
    assert made.status.collect()[0][:] == ("bi.epub", "ok")


def test_blocks_are_paired_tagged_and_veiled(merged):
    made, path = merged
    counts = made.statistics.agg(F.sum("n11"), F.sum(F.col("nxx") + F.col("a_only") + F.col("b_only")), F.count("*")).first()
    assert counts[:] == (6, 0, 2)
    page = chapter(path)
    assert page.count("Chapter One: The Beginning") == 2 and 'lang="en"' in page and 'xml:lang="fr"' in page
    assert 'class="b blurred" id="ch001-p1"' in page and 'href="#ch001-p3"' in page and 'class="a blurred"' not in page and '<div class="pair sec">' in page
    assert 'class="toolbar" data-nocontent="1"' in page and 'class="chap"' in page and "../js/peek.js" in page


@pytest.mark.parametrize("side", ["a", "none"])
def test_the_veiled_side_can_be_chosen(spark, pair, tmp_path, side):
    page = chapter(written(books.merged(*pair, blur_side=side, title="Mine", authors=["Me"]), tmp_path) / "bi.epub")
    assert ('class="a blurred"' in page) == (side == "a") and 'class="b blurred"' not in page and ("toggle-all" in page) == (side == "a") and ("noblur" in page) == (side == "none")
    opf = chapter(tmp_path / "bi.epub", "OEBPS/content.opf")
    assert "<dc:title>Mine</dc:title>" in opf and "<dc:creator>Me</dc:creator>" in opf and "Ann" not in opf
    with pytest.raises(ValueError):
        books.merged(*pair, blur_side="c")


def test_a_merged_book_splits_into_its_languages_and_merges_again(spark, merged, tmp_path):
    read = epub.packages(epub.archives(spark, str(merged[1])))
    made = books.split(read)
    written(made, tmp_path)
    assert sorted(p.name for p in tmp_path.glob("*.epub")) == ["bi.en.epub", "bi.fr.epub"]
    texts = {k: "".join(chapter(tmp_path / f"bi.{k}.epub", n) for n in ("OEBPS/text/ch001.xhtml", "OEBPS/text/ch002.xhtml")) for k in ("en", "fr")}
    assert "bright cold day" in texts["en"] and "journée froide" not in texts["en"] and "journée froide" in texts["fr"] and "bright cold day" not in texts["fr"]
    assert all("toggle" not in t and "Show" not in t for t in texts.values())
    opf = chapter(tmp_path / "bi.fr.epub", "OEBPS/content.opf")
    assert "<dc:language>fr</dc:language>" in opf and " (fr)</dc:title>" in opf and "<dc:creator>Cy</dc:creator>" in opf and "cover.png" in opf
    parts = epub.packages(epub.archives(spark, str(tmp_path)))
    side = lambda k: parts.where(F.endswith("path", F.lit(f"{k}.epub"))).withColumn("pair_id", F.lit("again.epub"))
    again = books.merged(side("en"), side("fr"))
    assert again.statistics.agg(F.sum("n11")).first()[0] == 6
    back = epub.blocks(parts.where(F.endswith("path", F.lit("en.epub")))).orderBy("seq").collect()
    assert [r["frag"].replace("</a>", "") for r in back] == [x for _, x in EN]


def test_why_there_is_no_book(spark, pair):
    a, b = pair
    empty = package(spark, [], "Empty", [], "fr")
    damaged = package(spark, FR, "X", [], "fr", status="damaged_index")
    for made, want in ((books.merged(a, empty), "no_text"), (books.merged(damaged, b), "damaged_index"), (books.merged(a, b, convert_side="b"), "no_opencc"), (books.merged(a, b, ceiling=1), "too_big")):
        assert made.status.first()["status"] == want and made.members.count() == 0


def test_scripts_are_converted_outside_tags(spark, pair, tmp_path):
    table = {"journée": "JOURNÉE", "journée froide": "FROID", "i": "y", "": "never"}
    page = chapter(written(books.merged(*pair, convert_side="b", tables=[table]), tmp_path) / "bi.epub")
    assert "une FROID dans la vylle" in page and "<i>ryvyère</i>" in page and "bright cold" in page


def longest_first(text, table):
    """The same by trying all phrases at each place, the longest first."""
    out = ""
    while text:
        p = next((p for p in sorted(table, key=len, reverse=True) if p and text.startswith(p)), None)
        out, text = (out + table[p], text[len(p) :]) if p else (out + text[0], text[1:])
    return out


def test_conversion_equals_trying_every_phrase(spark):
    draw = random.Random(5)
    for _ in range(300):
        table = {"".join(draw.choices("ab漢😀", k=draw.randint(1, 4))): draw.choice(["", "x", "ab", "字字"]) for _ in range(draw.randint(0, 8))}
        text = "".join(draw.choices("abc漢😀", k=draw.randint(0, 30)))
        assert script.convert(text, script.trie(table)) == longest_first(text, table)
    rows = spark.createDataFrame([("ab<ab c='ab'>abab</ab>&amp;",), (None,), ("",)], "frag string")
    got = [r[0] for r in rows.select(script.converted("frag", [{"ab": "1", "abab": "2"}, {"2": "two"}])).collect()]
    assert got == ["1<ab c='ab'>two</ab>&amp;", None, ""]
    with pytest.raises(ValueError):
        script.converted("frag", [{"a": "b" * (script.MAX_CHARS + 1)}])


def test_a_translation_becomes_a_book_that_pairs_with_its_source(spark, pair, tmp_path):
    source = epub.blocks(pair[0].withColumn("path", F.lit("town.epub")))
    own = exchange.export(source)
    meta = spark.createDataFrame([("town.epub", "The Invented Town", ["Ann"], "en", "zh")], "book string, title string, creators array<string>, lang string, target_lang string")
    made = books.imported(own, own.withColumn("text", F.concat(F.lit("ZH <"), "text")), meta)
    path = written(made, tmp_path) / "town.epub"
    page, opf = chapter(path), chapter(path, "OEBPS/content.opf")
    assert 'lang="zh"' in page and "ZH &lt;It was" in page and "<h2" in page and "The Invented Town (zh)" in opf and "<dc:language>zh</dc:language>" in opf
    built = epub.packages(epub.archives(spark, str(path))).withColumn("pair_id", F.lit("bi.epub"))
    again = books.merged(pair[0], built).statistics.agg(F.sum("n11"), F.sum(F.col("nxx") + F.col("a_only") + F.col("b_only"))).first()
    assert again[:] == (6, 0)
    made = books.imported(own, own.withColumn("text", F.when(F.col("i") == 3, "  ").otherwise("x")), meta, lang="de")
    assert made.status.first()["status"] == "empty_items" and made.members.count() == 0


def test_a_book_without_anything(spark, tmp_path):
    meta = spark.createDataFrame([("bare.epub", None, None, None, None, None, None), ("odd.epub", 'a & "b" <c>', ["x'y"], [], "P", "D", b"<svg/>")], books.BOOK)
    pages = spark.createDataFrame([], "book string, chapter int, title string, page string, scripted boolean")
    zips.write(books.members(pages, meta), str(tmp_path))
    assert "<dc:language>und</dc:language>" in chapter(tmp_path / "bare.epub", "OEBPS/content.opf")
    opf = chapter(tmp_path / "odd.epub", "OEBPS/content.opf")
    assert "a &amp; &quot;b&quot; &lt;c&gt;" in opf and "<dc:publisher>P</dc:publisher><dc:description>D</dc:description>" in opf and 'href="images/cover.svg" media-type="image/svg+xml"' in opf


def test_archives_appear_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"b{i}.zip", k, f"m{k:02}", b"%d-%d" % (i, k) * 50, k == 0) for i in range(4) for k in range(30)]
    members = spark.createDataFrame(rows, zips.MEMBERS).repartition(6, "name")
    zips.write(members, str(tmp_path / "out"))
    first = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert sorted(first) == ["b0.zip", "b1.zip", "b2.zip", "b3.zip"]
    for i in range(4):
        with zipfile.ZipFile(tmp_path / "out" / f"b{i}.zip") as z:
            assert z.namelist() == [f"m{k:02}" for k in range(30)] and z.read("m07") == b"%d-7" % i * 50 and z.testzip() is None
    zips.write(members.where("archive != 'b3.zip'"), str(tmp_path / "out"), "overwrite")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {k: v for k, v in first.items() if k != "b3.zip"}

    def fail(frames):
        for f in frames:
            if (f["archive"] == "b2.zip").any():
                raise RuntimeError("lost")
            yield f

    spark.dataSource.register(zips.Archives)
    torn = members.repartition(2, "archive").sortWithinPartitions("archive", "position").mapInPandas(fail, zips.MEMBERS)
    with pytest.raises(Exception, match="lost"):
        torn.write.format("archives").mode("append").option("path", str(tmp_path / "failed")).save()
    assert not any((tmp_path / "failed").iterdir())
    # rows of one archive that two tasks hold are refused, and leave nothing
    with pytest.raises(Exception, match="one archive"):
        members.repartition(3, "position").write.format("archives").mode("append").option("path", str(tmp_path / "torn")).save()
    assert not any((tmp_path / "torn").iterdir())


def test_small_archives_share_tasks_and_large_ones_are_read_by_documents(spark, tmp_path):
    meta = spark.createDataFrame([(f"b{i:03}.epub", f"T{i}", ["A"], ["fr"], None, None, PNG if i == 7 else None) for i in range(300)], books.BOOK)
    pages = meta.where("book != 'b001.epub'").selectExpr("book", "explode(sequence(1, if(book = 'b000.epub', 40, 2))) as chapter", "title", "concat('<body><p>', book, ' ', chapter, '</p></body>') as page", "false as scripted")
    zips.write(books.members(pages, meta), str(tmp_path))
    (tmp_path / "junk.epub").write_bytes(b"junk" * 100)
    read = epub.documents(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == 2
    got = epub.packages(epub.archives(spark, str(tmp_path)))
    name = F.substring_index("path", "/", -1).alias("path")
    one = read.where("coalesce(position, 0) = 0").select(name, "status", "title", "creators", "languages", "cover")
    assert sorted(map(str, one.collect())) == sorted(map(str, got.select(name, *one.columns[1:]).collect()))
    assert read.where("path like '%/b000.epub'").count() == 40 and read.where("position > 0 and cover is not null").count() == 0
    assert sorted(epub.blocks_of(read.withColumn("path", name)).collect()) == sorted(epub.blocks(got.withColumn("path", name)).collect())


def test_listings_read_no_more_than_the_directory(spark, tmp_path):
    def archive(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        return out.getvalue()

    good = archive({"mimetype": "application/epub+zip", "META-INF/container.xml": "x", "a/Ünï 12.XHTML": "y", "META-INF/encryption.xml": "z"})
    (tmp_path / "good.epub").write_bytes(good)
    (tmp_path / "junk.epub").write_bytes(b"junk")
    (tmp_path / "long.epub").write_bytes(b"junk" * 100)
    (tmp_path / "empty.epub").write_bytes(b"")
    (tmp_path / "none.zip").write_bytes(archive({}))
    broken = bytearray(good)
    broken[0:4] = b"XXXX"  # the type's own header is damaged, the directory isn't
    (tmp_path / "broken.epub").write_bytes(bytes(broken))
    with open(tmp_path / "big.epub", "wb") as f:  # of 3 GB, nearly all of them a hole
        f.seek(3 << 30)
        f.write(good)
    listed = zips.read(spark, str(tmp_path), files_per_task=2)
    got = {r["path"].rsplit("/", 1)[1]: r for r in epub.fingerprint(listed).collect()}
    assert {k: (r["is_zip"], r["bad_zip"], r["inspect_error"], r["entries"]) for k, r in got.items()} == {
        "good.epub": (True, False, None, 4), "junk.epub": (False, True, None, 0), "long.epub": (False, True, None, 0), "empty.epub": (False, True, None, 0), "none.zip": (True, False, None, 0),
        "broken.epub": (True, False, None, 4), "big.epub": (True, False, None, 4),
    }
    assert got["big.epub"]["bytes"] == (3 << 30) + len(good) and got["big.epub"]["mimetype"] == "application/epub+zip" and got["broken.epub"]["mimetype"] == "(unreadable)"
    assert got["good.epub"]["encrypted"] and got["good.epub"]["has_container"] and got["good.epub"]["sample_entries"][2] == "a/x #.XHTML" and got["good.epub"]["by_extension"][".xhtml"] == 1
    in_memory = epub.entries(spark.createDataFrame([("good.epub", good)], "path string, content binary"))
    assert [r["name"] for r in in_memory.orderBy("position").collect()] == ["mimetype", "META-INF/container.xml", "a/Ünï 12.XHTML", "META-INF/encryption.xml"]
    # a file that is too large to be read whole is a status
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in epub.packages(epub.archives(spark, str(tmp_path))).collect()}
    assert status["big.epub"] == "too_big" and status["junk.epub"] == "not_epub"
    tracemalloc.start()
    fs, at = zips.file_system(str(tmp_path / "big.epub"))
    assert len(list(zips.listing(at, None, lambda: zips.open_seekable(fs, at)))) == 4 and tracemalloc.get_traced_memory()[1] < 5 << 20
    tracemalloc.stop()


def test_identifiers(spark):
    names = ["bi.epub", "", "é/漢.epub"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(books.identifier(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert spark.createDataFrame([(b"<?xml v",), (b"<svg x",)], "c binary").select(tx.cover_type("c")).distinct().collect()[0][0] == "image/svg+xml"


def test_a_fingerprint_lists_each_archive_once(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for k in range(60):
            z.writestr(f"f{k % 12}/n{k}.e{k % 12}", "")
        z.writestr("a/one.opf", "")
    own = epub.fingerprint(zips.read(spark, str(tmp_path)))
    assert own._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 1
    got = own.first()
    assert got["entries"] == 61 and got["opf"] == ["a/one.opf"] and got["by_extension"] == {f".e{k}": 5 for k in range(10)}
    assert len(got["sample_entries"]) == 40 and got["sample_entries"][39] == "f3/x#.e3" and not got["has_container"] and not got["encrypted"]
