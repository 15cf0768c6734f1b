"""Web pages to clean text."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = ("script", "style", "nav", "footer", "header")
MIN_TEXT = 200


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside: list[str] = []
        self.descriptions: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.inside.append(tag)
        elif tag == "meta" and not self.inside:
            a = {k: v or "" for k, v in attrs}
            key = "og" if a.get("property") == "og:description" else "name" if a.get("name") == "description" else None
            if key and a.get("content"):
                self.descriptions.setdefault(key, a["content"].strip())

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside and self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def clean_text(html: str | None) -> str | None:
    """Text outside scripts, styles and page furniture, one phrase a line, after the page's description; null if there is none."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    phrases = (p.strip() for line in " ".join(parser.parts).splitlines() for p in line.strip().split("  "))
    text = "\n".join(p for p in phrases if p)
    about = parser.descriptions.get("og") or parser.descriptions.get("name")
    return "\n".join(x for x in (about, text) if x) or None


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_text: int = 0) -> DataFrame:
    """id_col, content of each page; with min_text, only pages of at least so many characters."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([clean_text(t.as_py()) for t in b.column(1)], pa.string())], ["id", "content"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, content string").withColumnRenamed("id", id_col)
    return out.where(F.length("content") >= min_text) if min_text else out
