import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomline.functions import text as tx
from loomline.operators import exchange, extract, languages
from loomline.operators.dealing import BATCH_BYTES, BATCH_ROWS, in_batches
from loomline.plans import books
from loomline.sources import epub, logs, zips
from loomline.streaming import buckets


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


def test_text_functions(spark):
    assert one(spark, "　\x1c a b\x85 ", tx.trimmed) == "a b"
    assert one(spark, "a<b>&", tx.escaped) == "a&lt;b&gt;&amp;"
    assert one(spark, "<i>x</i> &amp;lt;", tx.plain_text) == "x &lt;"
    assert one(spark, "h3", tx.heading_level) == 3 and one(spark, "html", tx.heading_level) is None
    assert one(spark, "Ünï x/y", tx.slug) == "Ünï_x_y"
    assert one(spark, "OEBPS/Kapitel 12.xhtml", tx.anonymous_name) == "OEBPS/x #.xhtml"
    assert tx.first_array("so: [1, [2]] [3]") == "[1, [2]]"
    with pytest.raises(ValueError):
        tx.cutoff("3w")


@pytest.mark.parametrize("text, want", [("open 'My Book.epub' failed", "open '<file>' failed"), ("at /srv/a/b c.epub now", "at <file> now"), ("in /usr/lib/x.py", "in /usr/lib/x.py"), ("in /usr/lib/x", "in <path>"), ("A/B stays", "A/B stays"), (None, "")])
def test_scrub_and_again(spark, text, want):
    got = one(spark, text, tx.scrubbed)
    assert got == want and one(spark, got, tx.scrubbed) == want


def test_cover_types(spark):
    rows = [(b"\x89PNG\r\n\x1a\n....",), (b"RIFF1234WEBP",), (b"RIFF1234WAVE",), (b"GIF89a",), (b"",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary").select(tx.cover_type("c")).collect()]
    assert got == ["image/png", "image/webp", "image/jpeg", "image/gif", "image/jpeg"]


@pytest.mark.parametrize("reply", ['["a", "b"]', '```json\n["a", "b"]\n```', 'Here: ["a", "b"] done', "1. a\n2) b", '[{"text": "a"}, {"translation": "b"}]'])
def test_replies(reply):
    assert tx.parse_reply(reply, 2) == ["a", "b"]


def test_reply_of_another_length():
    with pytest.raises(ValueError):
        tx.parse_reply('["a"]', 2)


def test_extraction_rules():
    doc = """<html xml:lang="xx"><head><title>t</title></head><body><div>bare<p>One <i>two</i><span>three</span><br/>&amp; <b> </b></p>
    <p data-nocontent="1">no</p><blockquote lang="fr">quoted</blockquote><blockquote><p>inside</p></blockquote><table><p>lost</p></table>
    <ul><li>a<ul><li>b</li></ul></li></ul><p>　</p><h2 xml:lang="de">H</h2></div></body></html>"""
    assert extract.parse(doc, "en") == [("p", "One <i>two</i>three<br/>&amp;", "en"), ("p", "quoted", "fr"), ("p", "inside", "en"), ("li", "ab", "en"), ("h2", "H", "de")]
    assert extract.parse("<p>no body</p>", "en") == [] and extract.parse("", None) == []


def test_tag_soup():
    assert [x[1] for x in extract.parse("<body><article><p>a<p>b <b>c</article><p>d</body>", None)] == ["a", "b <b>c</b>", "d"]


def test_trimming_is_that_of_python(spark):
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert set(tx.BLANK) == set(blanks)
    texts = [b + "a" + b + "b" + b for b in blanks] + ["".join(blanks), "", "\u200bx\u180e ", " \r\n"]
    assert [one(spark, t, tx.trimmed) for t in texts[-6:]] == [t.strip() for t in texts[-6:]]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1).select(tx.trimmed("x")).collect()] == [t.strip() for t in texts]


def test_references_end_in_a_semicolon():
    doc = "<body><h1>a&amp;&amp</h1><p>&lt x &copy; &copy &#65; &#65 &#x41; R&D & &;</p><p>b<script>if (a && b &amp c) {}</script></p></body>"
    assert [x[1] for x in extract.parse(doc, None)] == ["a&amp;&amp;amp", "&amp;lt x © &amp;copy A &amp;#65 A R&amp;D &amp; &amp;;", "bif (a &amp;&amp; b &amp;amp c) {}"]


def test_long_documents_go_in_bounded_batches(spark):
    html = "<body>" + "<p>" + "x" * 999 + "</p>"
    rows = [(str(i), 0, html + "<p>y</p>" * 3, None) for i in range(3000)]
    arrow = to_arrow_schema(T.StructType.fromDDL(extract.SCHEMA))
    sizes = [b.num_rows for b in in_batches((("b", k, "p", "x" * 1000, None) for k in range(9000)), arrow, lambda row: len(row[3]))]
    assert sum(sizes) == 9000 and max(sizes) <= BATCH_BYTES // 1000 + 1
    got = extract.blocks(spark.createDataFrame(rows, "book string, position int, html string, lang string").coalesce(1))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == BATCH_ROWS
    assert got.groupBy("book").count().where("count = 4").count() == 3000


def test_split_and_pairs(spark):
    rows = [("k", 0, "p", "a", "en"), ("k", 1, "p", "b", "fr"), ("k", 2, "h1", "c", ""), ("k", 3, "p", "d", "en")]
    df = spark.createDataFrame(rows, "book string, seq int, tag string, frag string, lang string")
    got = languages.split(df, ["en", "zz"]).orderBy("seq").collect()
    assert [(r["seq"], r["frag"]) for r in got] == [(0, "a"), (1, "d")]
    assert [r["lang"] for r in languages.order(df).orderBy("rank").collect()] == ["en", "fr", "und"]
    assert languages.pair_of(df).first()["status"] == "ok" and languages.pair_of(df.where("lang = 'en'")).first()["status"] == "one_language"
    assert languages.remerge(df.where("lang != ''")).agg(F.sum("a_n"), F.sum("b_n")).first()[:] == (2, 1)


def test_exchange_and_resume(spark):
    df = spark.createDataFrame([("k", i, "h1" if i == 0 else "p", f"t{i} &amp; <i>x</i>") for i in range(7)], "book string, seq int, tag string, frag string")
    own = exchange.export(df)
    assert [r["text"] for r in own.orderBy("i").collect()][:2] == ["t0 & x", "t1 & x"]
    books = spark.createDataFrame([("k", "T", ["c"], "en", "k.epub")], "book string, title string, creators array<string>, lang string, source_file string")
    assert exchange.read_export(exchange.payload(own, books)).count() == 7
    assert exchange.read_export(spark.createDataFrame([("k", '{"format": "x"}')], "book string, json string")).first()["status"] == "not_export"
    flaky = lambda texts: json.dumps([t.upper() for t in texts]) if len(texts) < 3 and "t4" not in texts[0] else "?"
    done = exchange.translate(own, flaky, own.where("i < 2"), batch=4, retries=1)
    got = {r["i"]: (r["text"], r["status"]) for r in done.collect()}
    assert sorted(got) == [2, 3, 4, 5, 6] and got[4] == (None, "failed") and got[2] == ("T2 & X", "done")
    assert exchange.validate(own, own.where("i < 6")).first()["status"] == "wrong_count"
    assert exchange.validate(own, own.withColumn("text", F.when(F.col("i") == 3, " ").otherwise("y"))).first()["empty"] == [3]
    assert exchange.built(own, own).where("tag = 'h2'").count() == 1


FILES = [
    ('["a", {"text": "b"}]', ["a", "b"], None), ('{"blocks": [{"i": 9, "text": "a"}], "target_lang": "zh"}', ["a"], "zh"), ('{"lang": "fr", "target_lang": "", "blocks": ["x", {"translation": "y"}, {"text": 5, "target": "z"}]}', ["x", "y", "z"], "fr"),
    ("a\n\nb\r\n  \nc\u2028d", ["a", "b", "c", "d"], None), ("[not json\nb", ["[not json", "b"], None), ("[Narrator] speaks\n{x}", ["[Narrator] speaks", "{x}"], None),
    ('["a", 5]', None, None), ('[{"other": "a"}]', None, None), ('{"target_lang": "zh"}', None, "zh"), ("7", None, None), ('"text"', None, None), ("[]", [], None), ("", [], None), (None, [], None), ("null", None, None), ('{"blocks": "x"}', None, None),
]


def test_translation_files(spark):
    df = spark.createDataFrame([(str(k), f[0]) for k, f in enumerate(FILES)], "book string, text string")
    got = {}
    for r in exchange.read_translations(df).collect():
        got.setdefault(r["book"], []).append((r["i"], r["text"], r["target_lang"], r["status"]))
    for k, (text, want, lang) in enumerate(FILES):
        rows = sorted(got.get(str(k), []), key=str)
        assert rows == ([(None, None, lang, "bad_translation")] if want is None else [(i, x, lang, "ok") for i, x in enumerate(want)]), text
    plan = exchange.read_translations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_epub_round_trip_and_bad_archives(spark, tmp_path):
    meta = spark.createDataFrame([("book.epub", "T & t", ["A"], ["fr"], None, None, b"\x89PNG\r\n\x1a\n")], books.BOOK)
    pages = spark.createDataFrame([("book.epub", 1, "C1", "<body><h1>C1</h1><p>one</p></body>", False), ("book.epub", 2, "C2", "<body><p>two</p></body>", False)], "book string, chapter int, title string, page string, scripted boolean")
    zips.write(books.members(pages, meta), str(tmp_path))
    book = (tmp_path / "book.epub").read_bytes()
    zips.write(books.members(pages, meta), str(tmp_path), "overwrite")
    assert book == (tmp_path / "book.epub").read_bytes()
    parts = {n: zipfile.ZipFile(io.BytesIO(book)).read(n) for n in zipfile.ZipFile(io.BytesIO(book)).namelist()}
    nested = archive({f"My Book/{k}": v for k, v in parts.items()} | {"__MACOSX/META-INF/container.xml": b"junk"})
    two = archive({f"{d}/{k}": v for k, v in parts.items() for d in "ab"})
    broken = archive(parts | {"META-INF/container.xml": b"<x"})
    files = spark.createDataFrame([("ok.epub", book), ("nested.epub", nested), ("two.epub", two), ("junk.epub", b"junk"), ("empty.epub", archive({"x": b""})), ("broken.epub", broken), ("big.epub", None)], "path string, content binary")
    got = {r["path"]: r for r in epub.packages(files).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"ok.epub": "ok", "nested.epub": "ok", "two.epub": "many_books", "junk.epub": "not_epub", "empty.epub": "no_book_in", "broken.epub": "damaged_index", "big.epub": "too_big"}
    assert (got["ok.epub"]["title"], got["ok.epub"]["creators"], got["ok.epub"]["languages"], got["ok.epub"]["cover_type"]) == ("T & t", ["A"], ["fr"], "image/png")
    rows = epub.blocks(epub.packages(files.where("path = 'nested.epub'"))).orderBy("seq").collect()
    assert [(r["tag"], r["frag"], r["lang"]) for r in rows] == [("h1", "C1", "fr"), ("p", "one", "fr"), ("p", "two", "fr")]
    shape = {r["path"]: r for r in epub.fingerprint(epub.entries(files)).collect()}
    assert shape["ok.epub"]["has_container"] and shape["ok.epub"]["opf"] == ["OEBPS/content.opf"] and not shape["ok.epub"]["encrypted"] and not shape["junk.epub"]["is_zip"]
    assert zipfile.ZipFile(io.BytesIO(book)).infolist()[0].filename == "mimetype"
    odd = spark.createDataFrame([("k", archive({n: b"" for n in (".hidden", "a/.x.txt", "B.TXT", "a.b/c", "META-INF/encryption.xml")}))], "path string, content binary")
    got = epub.fingerprint(epub.entries(odd)).first()
    assert got["by_extension"] == {"(none)": 2, ".txt": 2, ".xml": 1} and got["encrypted"]


def test_items_of_replies():
    assert [tx.item_text(x) for x in ("a", {"text": 5}, {"target": "b", "x": 1}, {"x": 1}, 7)] == ["a", "5", "b", "{'x': 1}", "7"]


def test_logs(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:00", "merge", "E", "open '/x/y.epub'", "t"), ("2024-01-02 00:00:00", "merge", "E", "open '/z/w.epub'", "t"), ("2024-01-02 00:00:00", "split", "E", "other", None)], "at_ts string, endpoint string, error_type string, error string, traceback string").withColumn("at_ts", F.to_timestamp("at_ts"))
    logs.append_failures(events, str(tmp_path / "log"))
    (tmp_path / "log" / "x.json").write_text("\nnot json\n")
    got = logs.read_failures(spark, str(tmp_path / "log"))
    assert got.count() == 3 and logs.read_failures(spark, str(tmp_path / "log"), F.to_timestamp(F.lit("2024-01-02"))).count() == 2
    assert [(r["reason"], r["n"]) for r in logs.reasons(got).collect()] == [("open '<file>'", 2), ("other", 1)]
    reports = spark.createDataFrame([("b", None, "m@x.example", None), ("a", None, None, None), ("c", "2024-01-01T00:00:00+00:00", "n@x.example", None)], "id string, resolved_at string, notify string, resolution string")
    assert [r["id"] for r in logs.listed(reports).collect()] == ["a", "b", "c"]
    out = {r["id"]: r for r in logs.resolve(reports, ["b", "c"], "done").collect()}
    assert out["b"]["to_notify"] == "m@x.example" and out["c"]["to_notify"] is None and out["b"]["notify"] is None
    d = logs.digest(got, reports).first()
    assert (d["failures"], d["reports_open"], d["reports_awaiting_reply"], d["idle"]) == (3, 2, 1, False)
    assert logs.digest(got.where("false"), reports.where("id = 'c'")).first()["idle"]
    jobs = spark.createDataFrame([("j1",), ("j2",)], "job string")
    assert [r["job"] for r in logs.killed(jobs, jobs.where("job = 'j1'")).collect()] == ["j2"]


def test_token_bucket_stream_is_its_batch_twin(spark, tmp_path):
    rows = [("u", float(t), i) for i, t in enumerate([0, 0, 0, 0, 0, 30, 31, 9000])] + [("v", 1.0, 99)]
    df = spark.createDataFrame(rows, "key string, at double, id long")
    batch = sorted((r["key"], r["id"], r["admitted"]) for r in buckets.token_bucket(df).collect())
    assert [x[2] for x in batch] == [True, True, True, True, False, True, False, True, True]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = buckets.token_bucket_stream(stream).writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r["key"], r["id"], r["admitted"]) for r in spark.sql("select * from bucket").collect()) == batch


def test_sessions_and_quota(spark):
    df = spark.createDataFrame([("u", 1, "2024-01-01 00:00:00"), ("u", 2, "2024-01-01 00:30:00"), ("u", 3, "2024-01-01 01:00:01")], "u string, event_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r["session"] for r in buckets.sessions(df, "u", "ts").orderBy("event_id").collect()] == [0, 0, 1]
    files = spark.createDataFrame([("s", i, 10) for i in range(3)], "session string, seq int, bytes int")
    assert [r["accepted"] for r in buckets.quota(files, max_files=2).orderBy("seq").collect()] == [True, True, False]


def test_reasons_are_whole_and_fall_back(spark):
    long = "x" * 160
    rows = [(1, long + "a", "T"), (2, long + "b", "T"), (3, None, "KeyError"), (4, "", "KeyError"), (5, None, None), (6, "at /srv/a/b c.epub", "T"), (7, "at /srv/z.epub", None)]
    df = spark.createDataFrame(rows, "at int, error string, error_type string")
    got = {r["reason"]: (r["n"], r["first"]) for r in logs.reasons(df).collect()}
    assert got == {long + "a": (1, 1), long + "b": (1, 2), "KeyError": (2, 3), "unknown": (1, 5), "at <file>": (2, 6)}
    assert logs.reasons(df.drop("error_type")).where("reason = 'unknown'").first()["n"] == 3
    reports = spark.createDataFrame([], "id string, resolved_at string, notify string")
    shown = logs.digest(df.withColumn("at", F.col("at").cast("string")), reports).first()
    assert shown["failures"] == 7 and {len(r["reason"]) for r in shown["by_reason"]} >= {150} and len(shown["by_reason"]) == 5


def test_log_lines_without_a_time_stay(spark, tmp_path):
    lines = ['{"at": "2024-01-02T00:00:00+00:00", "error": "a"}', "", "  ", '{"error": "b"}', "{broken", '{"at": "soon", "error": "c"}', '{"at": "2024-01-01T00:00:00+00:00", "error": "d", "more": 1}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert sorted(r["error"] for r in logs.read_failures(spark, str(tmp_path)).collect()) == ["a", "b", "c", "d"]
    assert [r["error"] for r in logs.read_failures(spark, str(tmp_path), F.to_timestamp(F.lit("2024-01-01 12:00:00"))).collect()] == ["a"]


TOKENS = [
    ("'a \"b.epub' c.epub\"", "'<file>' c.epub\""), ("it's 'x.ZIP' and \"y z.Json\"!", "it's '<file>' and \"<file>\"!"), ("'a\nb.epub'", "'a\nb.epub'"), ("''.epub'", "''<file>'"),
    ("/a/b//c/d", "<path><path>"), ("/a//b/c", "/a/<path>"), ("/a/b/", "<path>"), ("/a/b/x.py/", "<path>"), ("x /a b.epub.bak q", "x <file>.bak q"), ("/a.epubx /b", "/a.epubx /b"),
    ("/x  b.epub", "/x  b.epub"), ("e: /x/译.epub译 /q", "e: <path> /q"), ("http://h.org/es/12?x", "http:/<path>"), ("http://h.org", "http://h.org"), ('File "/usr/lib/python3/x.py", line 3', 'File "/usr/lib/python3/x.py", line 3'),
]


def test_scrubbing_token_by_token(spark):
    df = spark.createDataFrame([(a, b) for a, b in TOKENS], "a string, b string")
    for r in df.select("a", "b", tx.scrubbed("a").alias("got")).collect():
        assert r["got"] == r["b"], r["a"]


def test_killed_jobs_of_a_stream(spark, tmp_path):
    rows = [("a", 0, "start"), ("a", 50, "finish"), ("b", 10, "start"), ("c", 20, "start"), ("d", 30, "start"), ("d", 4000, "finish"), ("e", 100, "start"), ("c", 300, "finish"), ("end", 90_000, "start"), ("end", 90_000, "finish"), ("last", 99_000, "start"), ("last", 99_000, "finish")]
    df = spark.createDataFrame(rows, "job string, s long, kind string")
    log = tmp_path / "log"
    for part in range(0, len(rows), 3):  # c's finish comes long after later starts
        spark.createDataFrame(rows[part : part + 3], df.schema).coalesce(1).write.mode("append").json(str(log))
    of = lambda frame, kind: frame.where(F.col("kind") == kind).select("job", F.timestamp_seconds("s").alias("at_ts"))
    want = sorted(map(tuple, logs.killed(of(df, "start"), of(df, "finish"), "1 hour").select("job", "at_ts", "error_type").collect()))
    assert [w[0] for w in want] == ["b", "d", "e"]  # d ended when it was long taken for dead
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).json(str(log))
    out = logs.killed_stream(of(stream, "start"), of(stream, "finish"), "1 hour", "10 minutes")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("job", "at_ts", "error_type").collect())) == want
