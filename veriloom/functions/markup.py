"""HTML channels: visible text, and what only a model would see (comments, attributes, hidden elements)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import NONBLANK, arrow_lists

MARKUP_TAGS = ("web_content", "api_response", "retrieved_document")
_ATTRIBUTES = ("alt", "title", "aria-label", "placeholder", "data-tooltip")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("noscript", "script", "style"))
_GAP = r"\s*:\s*"
#: Properties, and values of them that hide an element.
_VALUES = {
    "display": "none",
    "visibility": "hidden",
    "opacity": r"0(?:\.0+)?\b",
    "font-size": r"0(?:%|em|px|rem)?\b",
    "color": r"(?:white|#fff|rgba?\(\s*" + r"\s*,\s*".join(["255"] * 3) + ")",
    "(?:left|top|text-indent)": r"-\d{3}",
    "clip": r"rect\(\s*0",
    "height": r"0(?:px)?\s*;.*overflow" + _GAP + "hidden",
}
_HIDING = re.compile("|".join(name + _GAP + value for name, value in _VALUES.items()), re.I | re.S)
CHANNELS = StructType([StructField("visible", StringType()), *[StructField(x, ArrayType(StringType())) for x in ("hidden", "comments", "attributes", "flags")]])


def hides(style: str) -> bool:
    return _HIDING.search(style) is not None


class _Channels(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, begins a hidden part, is silent
        self.visible, self.comments, self.attributes, self.hidden = [], [], [], []
        self.part: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        self.attributes += [v.strip() for k in _ATTRIBUTES if (v := values.get(k)) and v.strip()]
        covers = self.part is None and (hides(values.get("style") or "") or "hidden" in values)
        if tag in _VOID:
            return
        if covers:
            self.part = []
        self.open.append((tag, covers, tag in _SILENT))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while True:
                t, covers, _ = self.open.pop()
                if covers:
                    self.flush()
                if t == tag:
                    break

    def flush(self):
        if text := " ".join(self.part or ()):
            self.hidden.append(text)
        self.part = None

    def handle_comment(self, data):
        if data.strip():
            self.comments.append(data.strip())

    def handle_data(self, data):
        if not (text := data.strip()):
            return
        if self.part is not None:
            self.part.append(text)
        elif not any(silent for _, _, silent in self.open):
            self.visible.append(text)


def channels_of(page: str | None) -> tuple[str, list[str], list[str], list[str], list[str]]:
    if page is None or not page.strip():
        return "", [], [], [], []
    p = _Channels()
    p.feed(page)
    p.close()
    if p.part is not None:
        p.flush()
    flags = ["html_stripped"] + [f for f, x in (("html_comment_extracted", p.comments), ("attribute_text_extracted", p.attributes), ("hidden_css_detected", p.hidden)) if x]
    return " ".join(p.visible), p.hidden, p.comments, p.attributes, flags


_ARROW = pa.struct([("visible", pa.string()), *((x, pa.list_(pa.string())) for x in ("hidden", "comments", "attributes", "flags"))])
_NAMES = [f.name for f in _ARROW]


@F.pandas_udf(CHANNELS)
def channels(s: pd.Series) -> pd.DataFrame:
    """A page's text by channel, in the order visible, hidden, comments, attributes; flags name the channels that speak."""
    return pd.DataFrame([channels_of(x) for x in s], columns=_NAMES)


@F.arrow_udf(ArrayType(CHANNELS))
def channels_of_each(pages: pa.Array) -> pa.Array:
    """channels() of every page of an array; null for null."""
    return arrow_lists(pages, _ARROW, lambda x: dict(zip(_NAMES, channels_of(x))))


def looks_like_html(c: Column) -> Column:
    return c.contains("<") & c.rlike("<[!/A-Za-z][^>]*>")


def pieces(c: Column) -> Column:
    """All non-blank texts of channels(...), visible first."""
    every = F.concat(F.array(c["visible"]), c["hidden"], c["comments"], c["attributes"])
    return F.filter(every, lambda x: x.isNotNull() & x.rlike(NONBLANK))
