"""HTML pages: headings, paragraphs, links and table rows as events, and readers built on them."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_TAGS = ("title", "h1", "h2", "h3", "h4", "th", "td", "dt", "dd", "li", "p")


class _Events(HTMLParser):
    """(tag, text) of the wanted tags in document order; scripts and styles are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in EVENT_TAGS:
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                name, parts = self.open.pop(k)
                self.found.append((name, " ".join("".join(parts).split())))
                break

    def handle_data(self, data):
        if not self.skip:
            for _, parts in self.open:
                parts.append(data)


def events_of(html: str | None) -> list[dict]:
    parser = _Events()
    parser.feed(html or "")
    parser.close()
    return [{"tag": t, "text": x} for t, x in parser.found]


def html_events(column: str):
    @F.pandas_udf("array<struct<tag:string,text:string>>")
    def read(html: pd.Series) -> pd.Series:
        return html.map(events_of)

    return read(column)


def events(pages: DataFrame) -> DataFrame:
    """page_id, pos, tag, text."""
    return pages.select("page_id", F.posexplode(html_events("html")).alias("pos", "e")).select("page_id", "pos", "e.tag", "e.text")


def coverage_rows(pages: DataFrame) -> DataFrame:
    """Pages of counts: 'a of b' under the last heading before: page_id, section, held, known."""

    def read(batches):
        for pdf in batches:
            rows = []
            for page_id, html in zip(pdf.page_id, pdf.html):
                section = None
                for e in events_of(html):
                    if e["tag"] in ("h1", "h2", "h3", "h4"):
                        section = e["text"]
                    else:
                        import re

                        if m := re.search(r"(\d[\d,]*) of (\d[\d,]*)", e["text"]):
                            rows.append((page_id, section, *(int(x.replace(",", "")) for x in m.groups())))
            yield pd.DataFrame(rows, columns=["page_id", "section", "held", "known"]).astype({"page_id": "int64", "held": "int64", "known": "int64"})

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, section string, held long, known long")


def missing_rows(pages: DataFrame) -> DataFrame:
    """Pages of missing matches: under a heading, dt holds a date and dd 'A vs B'."""
    rows = events(pages)
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda tags: F.last(F.when(F.col("tag").isin(*tags), F.col("text")), True).over(w)
    rows = rows.withColumns({"section": last(("h1", "h2", "h3", "h4")), "date": last(("dt",))})
    sides = F.split("text", r"\s+vs?\.?\s+")
    return rows.filter((F.col("tag") == "dd") & (F.size(sides) == 2)).select("page_id", "section", "date", sides[0].alias("team1"), sides[1].alias("team2"))


def month(column: str):
    """'Mon YYYY' as 'YYYY-MM'."""
    return F.date_format(F.to_date(F.col(column), "MMM yyyy"), "yyyy-MM")


def withheld(column: str):
    """Number and reason of a note like '12 matches are withheld because ...'."""
    return F.regexp_extract(column, r"(\d+)[^.]*withheld", 1).try_cast("int"), F.trim(F.regexp_extract(F.regexp_replace(column, "<[^>]*>", ""), r"withheld (?:because|for|due to) ([^.]*)", 1))
