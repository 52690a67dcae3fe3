"""Scalar functions over block text, as column expressions; Python only where no expression has the meaning."""

from __future__ import annotations

import html
import json
import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's str.strip() removes.
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Extensions that data files in messages have.
DATA_FILES = ("epub", "zip", "xhtml", "html", "htm", "opf", "ncx", "jpg", "jpeg", "png", "gif", "css", "ttf", "otf", "txt", "json")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(c: Column | str) -> Column:
    """Markup removed, entities as they are: lengths in the cost model count "&amp;" as 5."""
    return F.regexp_replace(col(c), "<[^>]+>", "")


def trimmed(c: Column | str) -> Column:
    """Without blanks at both ends, in the Unicode sense (trim() knows only the space)."""
    return F.btrim(col(c), F.lit(BLANK))


def escaped(c: Column | str, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else out


def unescaped(c: Column | str) -> Column:
    """The five entities that writers here use; unescape_all() has every named one."""
    out = col(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


@F.pandas_udf(T.StringType())
def unescape_all(s):  # noqa: ANN001, ANN201
    return s.map(lambda x: None if x is None else html.unescape(x))


def title_text(c: Column | str) -> Column:
    """A heading as a title: tags stripped, trimmed, empty for null."""
    return F.coalesce(trimmed(strip_tags(c)), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.length(trimmed(F.replace(strip_tags(c), F.lit("　"), F.lit(" ")))) == 0


def plain_text(c: Column | str) -> Column:
    """Text as an external translator sees it: no tags, entities resolved, wide spaces as spaces, trimmed."""
    return trimmed(F.replace(unescaped(strip_tags(c)), F.lit("　"), F.lit(" ")))


def heading_level(tag: Column | str) -> Column:
    return F.when(col(tag).rlike("^h[0-9]$"), F.substring(col(tag), 2, 1).cast("int"))


def is_heading(tag: Column | str) -> Column:
    return F.startswith(col(tag), F.lit("h"))


def local_name(tag: Column | str) -> Column:
    return F.lower(F.substring_index(col(tag), "}", -1))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)[^\w.-]+", "_")


def chapter_id(n: Column | str) -> Column:
    return F.format_string("ch%03d", col(n))


def chapter_title(title: Column | str, n: Column | str) -> Column:
    return F.coalesce(F.nullif(title_text(title), F.lit("")), F.format_string("Chapter %d", col(n)))


def language(lang: Column | str) -> Column:
    return F.coalesce(F.nullif(col(lang), F.lit("")), F.lit("und"))


def _tokens(text: Column, token: str) -> Column:
    """The text in tokens of the pattern, and all else character by character."""
    return F.regexp_extract_all(text, F.lit(rf"(?sU)({token}|.)"), F.lit(1))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), which is computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _without_quoted_files(text: Column) -> Column:
    """A quote, its next equal, and between them one line that ends as a data file does: only the quotes stay. From left to right; what closes one quotation opens none."""

    def marked(tokens: Column) -> Column:
        """Each token with how many tokens on the quotation that begins here ends, 0 if it isn't one of a file."""
        nearest = F.transform(tokens, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.when(x.isin("'", '"'), F.array_position(F.slice(tokens, i + 2, F.size(tokens)), x)).otherwise(0).cast("int").alias("on")))
        ends = lambda t: F.lower(F.get(tokens, t["i"] + t["on"] - 1)).rlike(rf"\.({'|'.join(DATA_FILES)})$")
        one_line = lambda t: ~F.exists(F.slice(tokens, t["i"] + 2, t["on"]), lambda y: F.contains(y, F.lit("\n")))
        return F.transform(nearest, lambda t: F.struct(t["x"], t["i"], F.when((t["on"] > 1) & ends(t) & one_line(t), t["on"]).otherwise(0).alias("on")))

    def step(s: Column, t: Column) -> Column:
        opens = F.concat(s["out"], t["x"], F.lit("<file>"), t["x"])
        return F.when(t["i"] < s["next"], s).otherwise(F.struct(F.when(t["on"] > 0, opens).otherwise(F.concat(s["out"], t["x"])).alias("out"), (t["i"] + t["on"] + 1).alias("next")))

    whole = F.aggregate(_let(_tokens(text, r"[^'\"]+"), marked), F.struct(F.lit("").alias("out"), F.lit(0).alias("next")), step, lambda s: s["out"])
    return F.when(text.rlike("['\"]"), whole).otherwise(text)


def _without_bare_files(text: Column) -> Column:
    """In each run of words with single blanks, without quotes or colons: what stands from its first slash to its last data file."""
    runs = _tokens(text, r"(?:[^\s'\":]|[ \t](?=[^\s'\":]))+")
    return F.array_join(F.transform(runs, lambda x: F.when(F.contains(x, F.lit("/")), F.regexp_replace(x, rf"(?isU)/.*\.(?:{'|'.join(DATA_FILES)})\b", "<file>")).otherwise(x)), "")


def _without_paths(text: Column) -> Column:
    """In each word, two or more names that slashes lead to, with the slash that ends them, unless the last is a Python source."""

    def names(s: Column, p: Column) -> Column:
        n = F.size(s["held"])
        ended = F.when(n == 0, "/").when(n == 1, F.concat(F.lit("/"), F.get(s["held"], F.lit(0)), F.lit("/"))).otherwise("<path>")
        return F.when(p != "", F.struct(s["out"], F.array_append(s["held"], p).alias("held"))).otherwise(F.struct(F.concat(s["out"], ended).alias("out"), none.alias("held")))

    def rest(s: Column) -> Column:
        n, whole = F.size(s["held"]), F.concat(F.lit("/"), F.array_join(s["held"], "/"))
        return F.concat(s["out"], F.when(n == 0, "").when((n == 1) | F.endswith(whole, F.lit(".py")), whole).otherwise("<path>"))

    def word(parts: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.struct(F.get(parts, F.lit(0)).alias("out"), none.alias("held")), names, rest)

    none = F.array().cast("array<string>")
    words = _tokens(text, r"[^\s'\"]+")
    return F.array_join(F.transform(words, lambda w: F.when(F.contains(w, F.lit("/")), _let(F.split(w, "/"), word)).otherwise(w)), "")


def scrubbed(c: Column | str) -> Column:
    """Nothing that could name a file; null gives an empty text. Token by token: quoted data files, data files with blanks in their names, then paths."""
    return _let(F.coalesce(col(c), F.lit("")), lambda text: _without_paths(_without_bare_files(_without_quoted_files(text))))


def anonymous_name(c: Column | str) -> Column:
    """An archive entry's shape without its words: runs of digits are #, of letters x, a stem is 32 characters at most; folder and extension stay."""
    name = col(c)
    folder = F.regexp_extract(name, "^(.*/)", 1)
    leaf = F.substring_index(name, "/", -1)
    extension = F.when(leaf.rlike(r"^.+\.[^.]*$"), F.regexp_extract(leaf, r"(\.[^.]*)$", 1)).otherwise(F.lit(""))
    stem = F.substring(leaf, F.lit(1), F.length(leaf) - F.length(extension))
    runs = F.regexp_replace(F.regexp_replace(stem, r"\p{Nd}+", "#"), r"[\p{L}\p{Nl}\p{No}]+", "x")
    return F.concat(folder, F.left(runs, F.lit(32)), extension)


def cover_type(content: Column | str) -> Column:
    """Media type of an image by its first bytes; JPEG where none is known."""
    head = F.hex(F.substring(col(content), 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("3C3F786D6C") | head.startswith("3C737667"), "image/svg+xml")
        .otherwise("image/jpeg")
    )


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def cutoff(spec: str, now: Column | None = None) -> Column:
    """The time that a spec such as 12h or 7d goes back to; ValueError for any other unit."""
    m = re.fullmatch(r"(\d+)([hd])", spec)
    if not m:
        raise ValueError(f"{spec!r} is not a number of hours or days")
    return (now if now is not None else F.current_timestamp()) - F.expr(f"make_dt_interval({m[1] if m[2] == 'd' else 0}, {m[1] if m[2] == 'h' else 0})")


def upper_median(values: Column | str) -> Column:
    """Of an array: the element at half its size, the upper one of two middle ones; null for an empty array."""
    v = F.array_sort(F.filter(col(values), lambda x: x.isNotNull()))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def first_array(text: str) -> str | None:
    """The first [...] whose brackets balance. Brackets in string literals count, as in the files this reads."""
    begin = text.find("[")
    depth = 0
    for i in range(begin, len(text)) if begin >= 0 else ():
        depth += {"[": 1, "]": -1}.get(text[i], 0)
        if depth == 0:
            return text[begin : i + 1]
    return None


def item_text(item: object) -> str:
    """A reply's item: a string, or the first there is of its text, translation and target; of others str() is taken."""
    if isinstance(item, dict):
        item = next((item[key] for key in ("text", "translation", "target") if key in item), item)
    return str(item)


def numbered_lines(text: str) -> list[str]:
    return [m[1].strip() for line in text.splitlines() if (m := re.match(r"^\s*\d+\s*[.)：:]\s*(.+)", line))]


def unfenced(text: str) -> str:
    """What stands between the first two code fences, without the language's name, or the whole text; trimmed."""
    parts = text.split("```", 2)
    return (parts[1].lstrip(string.ascii_letters) if len(parts) == 3 else text).strip()


def json_items(text: str | None) -> list[str]:
    """The items of a JSON list as texts; none if it is something else."""
    try:
        items = json.loads(text or "")
    except ValueError:
        return []
    return [item_text(x) for x in items] if isinstance(items, list) else []


#: Readers of a reply, in the order in which they are tried: all of it as JSON, the first array in it, numbered lines.
READERS = (json_items, lambda text: json_items(first_array(text)), numbered_lines)


def parse_reply(text: str, want: int) -> list[str]:
    """The translator's reply as `want` strings, by the first reader that finds so many. ValueError if none does."""
    body = unfenced(text)
    for reader in READERS:
        if len(items := reader(body)) == want:
            return items
    raise ValueError(f"the reply doesn't hold {want} items")
