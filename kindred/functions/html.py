"""Rows of HTML tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def table_row(*cells: Column, header: bool = False, classes: str = "") -> Column:
    """A row of cells as text; nulls are empty."""
    tag = "th" if header else "td"
    opening = f'<tr class="{classes}">' if classes else "<tr>"
    return F.concat(F.lit(opening), *[F.concat(F.lit(f"<{tag}>"), escaped(c.cast("string")), F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))
