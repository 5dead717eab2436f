"""Plain text of HTML: a walk over the document's nodes."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Elements whose text is no content, and those before which a line breaks.
HIDDEN, BREAKING = frozenset({"script", "style"}), frozenset({"p", "br"})


class _Walk(HTMLParser):
    """Gathers text nodes: whether one is blank is asked of the text as it is written, before entities are decoded."""

    def __init__(self, newline: str):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.node: list[str] = []
        self.hidden, self.newline = 0, newline

    def end_node(self) -> None:
        raw = "".join(self.node)
        if raw.strip() and not self.hidden:
            self.out.append(html.unescape(raw))
        self.node = []

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag in BREAKING:
            self.out.append(self.newline)
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.end_node()
        if tag in BREAKING:
            self.out.append(self.newline)

    def handle_endtag(self, tag):
        self.end_node()
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_comment(self, data):
        self.end_node()

    def handle_decl(self, decl):
        self.end_node()

    def handle_data(self, data):
        self.node.append(data)

    def handle_entityref(self, name):
        end = self.rawdata[self._place() + 1 + len(name) :][:1]
        self.node.append(f"&{name}{';' if end == ';' else ''}")

    def handle_charref(self, name):
        end = self.rawdata[self._place() + 2 + len(name) :][:1]
        self.node.append(f"&#{name}{';' if end == ';' else ''}")

    def _place(self) -> int:
        line, column = self.getpos()
        return self._line_starts[line - 1] + column

    def feed(self, page):
        self._line_starts = [0, *(i + 1 for i, c in enumerate(page) if c == "\n")]
        super().feed(page)


def plain_text(page: str | None, newline: str = "\r\n") -> str | None:
    """Text of all nodes but comments, scripts, styles and blank ones, with a line break before ``p`` and ``br`` only.
    Entities are decoded. Null stays null."""
    if page is None:
        return None
    walk = _Walk(newline)
    walk.feed(page)
    walk.close()
    walk.end_node()
    return "".join(walk.out)


@pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(plain_text)


def upload_text(content: Column, strip_html: Column) -> Column:
    """The text of an upload: stripped only where the sender asked for it."""
    return F.when(F.coalesce(strip_html, F.lit(False)), html_to_text(content)).otherwise(content)
