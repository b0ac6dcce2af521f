"""Tables in web pages, those hidden in comments too: one row for each grid place that a cell covers."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<(/?)(tr|td|th|table)\b([^>]*)>|<[^>]*>|([^<]+)", re.IGNORECASE)
SPAN = re.compile(r"\b(row|col)span\s*=\s*[\"']?(\d+)", re.IGNORECASE)
MOST_SPAN = 1000  # of rows or columns, as in browsers


def table_html(page: Column, table_id: str) -> Column:
    """The table of that id: in the first comment that names it, else in the page itself; null if there is none."""
    named = rf"""id=["']{re.escape(table_id)}["']"""
    hidden = F.regexp_extract(page, rf"(?s)<!--((?:(?!-->).)*?{named}.*?)-->", 1)
    body = F.when(hidden != "", hidden).otherwise(F.regexp_replace(page, r"(?s)<!--.*?-->", ""))
    found = F.regexp_extract(body, rf"(?si)(<table\b[^>]*{named}.*?</table>)", 1)
    return F.when(found != "", found)


def grid(table: str) -> list[tuple[int, int, str, bool]]:
    """(row, column, text, heading) of every place that a cell covers; spans push later cells aside and end with the table."""
    cells, row, col, taken, open_ = [], -1, 0, set(), None
    for close, tag, attributes, text in TOKEN.findall(table):
        tag = tag.lower()
        if tag in ("tr", "td", "th", "table") and open_ is not None:
            cells.append((*open_[:4], re.sub(r"\s+", " ", entities.unescape("".join(open_[4]))).strip(), open_[5]))
            open_ = None
        if tag == "tr" and not close:
            row, col = row + 1, 0
        elif tag in ("td", "th") and not close and row >= 0:
            size = {k.lower(): min(MOST_SPAN, max(1, int(n))) for k, n in SPAN.findall(attributes)}
            while (row, col) in taken:
                col += 1
            high, wide = size.get("row", 1), size.get("col", 1)
            taken |= {(row + i, col + j) for i in range(high) for j in range(wide)}
            open_ = (row, col, high, wide, [], tag == "th")
            col += wide
        elif text and open_ is not None:
            open_[4].append(text)
    return [(r + i, c + j, t, h) for r, c, high, wide, t, h in cells for i in range(high) if r + i <= row for j in range(wide)]


def table_cells(pages: DataFrame, key: str, page: str, table_id: str) -> DataFrame:
    """pages -> (key, row, col, text, heading): the places of each page's table of that id; pages without it have none."""

    @F.pandas_udf("array<struct<row: int, col: int, text: string, heading: boolean>>")
    def places(tables: pd.Series) -> pd.Series:
        return tables.map(lambda t: [dict(zip(("row", "col", "text", "heading"), c)) for c in grid(t)])

    found = pages.select(key, table_html(F.col(page), table_id).alias("_t")).where("_t is not null")
    return found.select(key, F.inline(places("_t")))
