"""Conversion between scripts: the longest phrase of a table at each place of a text, tags left as they are. The tables are the caller's."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the phrases of all tables may have together: the tables go to every task.
MAX_CHARS = 20_000_000
_TAG = re.compile(r"(<[^>]+>)")
_END = ""  # no character: where a phrase of the trie ends


def trie(table: Mapping[str, str]) -> dict:
    """Nested dictionaries by character; what a phrase becomes is under its end. An empty phrase is none."""
    root: dict = {}
    for phrase, to in table.items():
        node = root
        for c in phrase:
            node = node.setdefault(c, {})
        if node is not root:
            node[_END] = to
    return root


def convert(text: str, root: dict) -> str:
    """At each place the longest phrase that begins there is replaced and passed; a character that begins none stays."""
    out, at = [], 0
    while at < len(text):
        node, end, to, k = root, at + 1, text[at], at
        while k < len(text) and (node := node.get(text[k])):
            k += 1
            if _END in node:
                end, to = k, node[_END]
        out.append(to)
        at = end
    return "".join(out)


def convert_outside_tags(frag: str, roots: Sequence[dict]) -> str:
    """Each stretch between tags by one table after another; no phrase reaches over a tag."""
    parts = _TAG.split(frag)
    for k in range(0, len(parts), 2):  # the others are the tags
        for root in roots:
            parts[k] = convert(parts[k], root)
    return "".join(parts)


def converted(frag: Column | str, tables: Sequence[Mapping[str, str]]) -> Column:
    """frag in the other script, by tables that are applied in turn; null stays null. ValueError for tables too large to be sent to every task."""
    if sum(len(p) + len(t) for table in tables for p, t in table.items()) > MAX_CHARS:
        raise ValueError(f"the tables have more than {MAX_CHARS} characters")
    tables = [dict(t) for t in tables]

    @F.pandas_udf("string")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        roots = [trie(t) for t in tables]  # once for a task
        for frags in frames:
            yield frags.map(lambda x: None if x is None else convert_outside_tags(x, roots))

    return run(F.col(frag) if isinstance(frag, str) else frag)
