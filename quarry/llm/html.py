"""Content of HTML pages by text-to-tag ratios.

Events of the standard library's streaming parser are booked by line; a line ends at a line
feed of the source or at a block-level tag. Each line's ratio is its text's length over its
number of tags, taken as a logarithm so that one long paragraph doesn't outweigh the rest.
The ratios are smoothed with a Gaussian kernel, and lines at or above the threshold, a
multiple of the smoothed ratios' standard deviation, form the content.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column, spare, table

#: Production parameters: kernel's width, multiple of the deviation, characters fed at a time.
SIGMA, FACTOR, PIECE = 1.0, 1.4, 1 << 16
_BLOCKS = frozenset(
    "address article aside blockquote body br button dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_SILENT = frozenset(("script", "style", "noscript", "template", "svg", "head"))
#: Of these, those that may be left open by mistake: they hide text only if an end tag follows.
_CLOSED = ("noscript", "template", "svg")
#: Start tags that may stand in a head; any other ends it, as HTML lets </head> be left out.
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template svg head html".split())


class Lines(HTMLParser):
    """Text and number of tags of each line."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.ends = {tag: [m.start() for m in re.finditer(f"</{tag}", html, re.IGNORECASE)] for tag in _CLOSED}
        self.starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.title = False
        self.text: list[list[str]] = [[]]
        self.tags: list[int] = [0]
        self.hidden: list[str] = []

    def _closes(self, tag: str) -> bool:
        """Whether an end tag follows this start tag."""
        line, column = self.getpos()
        ends = self.ends[tag]
        return bool(ends) and ends[-1] > self.starts[line - 1] + column

    def _next(self) -> None:
        if self.text[-1] or self.tags[-1]:
            self.text.append([])
            self.tags.append(0)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._next()
        self.tags[-1] += 1
        if tag == "body" or (self.hidden in (["head"], ["head", "noscript"]) and tag not in _IN_HEAD):
            self.hidden.clear()
        self.title = tag == "title"
        if tag in _SILENT and (tag not in _CLOSED or self._closes(tag)):
            self.hidden.append(tag)

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCKS:
            self._next()
        self.tags[-1] += 1

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif tag == "body":
            self.hidden.clear()
        self.title = self.title and tag != "title"
        self.tags[-1] += 1
        if tag in _BLOCKS:
            self._next()

    def handle_data(self, data):
        if self.hidden == ["head"] and not self.title and data.strip():
            self.hidden.clear()
        if self.hidden:
            return
        first, *more = data.split("\n")
        if first.strip():
            self.text[-1].append(first)
        elif first and self.text[-1]:
            self.text[-1].append(" ")  # a blank between inline tags parts words
        for part in more:
            self._next()
            if part.strip():
                self.text[-1].append(part)


def lines_of(html: str) -> tuple[list[str], np.ndarray]:
    """Texts of all lines, with white space drawn together, and their numbers of tags."""
    parser = Lines(html)
    for at in range(0, len(html), PIECE):
        parser.feed(html[at : at + PIECE])
    parser.close()
    if len(parser.text) > 1 and not parser.text[-1] and not parser.tags[-1]:
        del parser.text[-1], parser.tags[-1]
    return [" ".join("".join(t).split()) for t in parser.text], np.array(parser.tags)


def kernel(sigma: float) -> np.ndarray:
    reach = int(np.ceil(2 * sigma))
    weight = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return weight / weight.sum()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Weighted means over the neighbours that exist."""
    weight = kernel(sigma)
    reach = len(weight) // 2
    total = np.convolve(ratios, weight)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weight)[reach : reach + len(ratios)]


def content(html: str, sigma: float = SIGMA, factor: float = FACTOR) -> str:
    """The lines of the content, each on a line of its own."""
    texts, tags = lines_of(html)
    ratios = np.log1p(np.array([len(t) for t in texts], float) / np.maximum(tags, 1))
    level = smoothed(ratios, sigma)
    cut = factor * level.std()
    return "\n".join(t for t, x in zip(texts, level >= cut, strict=True) if x and t)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "content", sigma: float = SIGMA, factor: float = FACTOR) -> DataFrame:
    """``pages`` with the content of each page.

    Null pages give null, empty ones and those without text "". Pages without tags are all
    content if their lines are alike; broken markup is read as the parser recovers it.
    Pages of any length are read whole. Repeated rows are treated alike. Other columns are
    kept; one named like ``text_col`` is replaced. An empty table stays empty.
    """

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else content(h, sigma, factor) for h in rows], dtype=object)

    (name,) = spare(pages, "made")
    out = pages.withColumn(name, run(column(pages, html_col)))
    return out.select(*[column(out, c) for c in pages.columns if c.lower() != text_col.lower()], F.col(name).alias(text_col))


def op8_html(spark, sf_dir):
    """Content of all pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


QUERIES = {"op8_html": op8_html}
ORACLE: dict[str, str] = {}
