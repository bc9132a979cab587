"""Dates of search hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

#: Accepted layouts, in order, after whole numbers (Unix seconds, or milliseconds above 10^12).
_LAYOUTS = [
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$", None),
    (r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", "dd MMM yyyy HH:mm:ss Z"),
    (r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{3}$", "dd MMM yyyy HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
]


def parse_date(text: Column) -> Column:
    """a timestamp (session time zone UTC), or null."""
    number = F.when(F.rlike(text, F.lit(r"^[+-]?\d{1,18}$")), text.cast("long"))
    seconds = F.when(number > 1_000_000_000_000, F.floor(number / 1000)).otherwise(number)
    parsed = [F.when(number.isNotNull(), F.timestamp_seconds(seconds))]
    for shape, layout in _LAYOUTS:
        value = text
        if layout and layout.startswith("dd MMM"):  # the weekday does not bear on the date; a zone abbreviation counts as UTC
            value = F.substring(text, 6, 26 if layout.endswith("Z") else 20)
        parsed.append(F.when(F.rlike(text, F.lit(shape)), F.try_to_timestamp(value, F.lit(layout)) if layout else F.try_to_timestamp(value)))
    return F.coalesce(*parsed)


def first_date(texts: list[Column]) -> tuple[Column, Column]:
    """(published_at, raw): the first text that parses; else null with the first one that is not empty."""
    tidy = [F.nullif(trim_space(t), F.lit("")) for t in texts]
    raw = F.coalesce(*[F.when(parse_date(t).isNotNull(), t) for t in tidy], *tidy)
    return F.coalesce(*[parse_date(t) for t in tidy]), F.coalesce(raw, F.lit(""))
