"""Text of markup: block elements end lines, references are decoded."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that end a line.
BLOCKS = frozenset("article blockquote br dd div dl dt h1 h2 h3 h4 h5 h6 hr li ol p section table tbody td th thead tr ul".split())

#: A comment, a script or style with what it holds, a declaration, or a tag.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(script|style)\b[^>]*>(?P<raw>.*?)(?:</\1\s*>|\Z)
      | <[!?][^>]*>
      | </?(?P<name>[A-Za-z][^\s/<>]*)(?:[^<>"']|"[^"]*"|'[^']*')*>""",
    re.S | re.I | re.X,
)


def _runs(markup: str) -> Iterator[str | None]:
    """Runs of text in order, None where a line ends."""
    at = 0
    for found in MARKUP.finditer(markup):
        yield html.unescape(markup[at : found.start()])
        yield found["raw"] or ""
        if (found["name"] or "").lower() in BLOCKS:
            yield None
        at = found.end()
    yield html.unescape(markup[at:])


def lines_of(markup: str | None) -> str:
    """The lines of a page's text, white space within a line as one space, without empty
    lines.  A run of white space between two tags is no text.  What scripts and styles hold
    is text as it stands; null is as empty."""
    text = "".join("\n" if run is None else run for run in _runs(markup or "") if run is None or run.strip())
    return "\n".join(line for line in (" ".join(x.split()) for x in text.splitlines()) if line)


def _block_text(markup: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in markup:
        yield batch.map(lines_of)


def block_text(markup: Column) -> Column:
    return F.pandas_udf(_block_text, "string")(markup)


def _block_texts(markup: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in markup:
        yield batch.map(lambda pages: [lines_of(m) for m in pages], na_action="ignore")


def block_texts(markups: Column) -> Column:
    """``block_text`` of every element of an array."""
    return F.pandas_udf(_block_texts, "array<string>")(markups)
