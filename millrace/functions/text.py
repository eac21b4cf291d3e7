"""Scalars over names, parts and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_full_name(c: Column) -> tuple[Column, Column]:
    """(first, last) at the last space; a single word is the first, blank or null gives two empty texts."""
    t = F.coalesce(F.trim(c), F.lit(""))
    many = t.contains(" ")
    first = F.when(many, F.trim(F.regexp_extract(t, "^(.+) [^ ]+$", 1))).otherwise(t)
    return first, F.when(many, F.regexp_extract(t, "[^ ]+$", 0)).otherwise(F.lit(""))


def concat_names(first: Column, last: Column) -> Column:
    return F.trim(F.concat_ws(" ", first, last))


def merge_json(a: Column, b: Column) -> Column:
    """Two JSON objects of one level, keys of the second winning; values come back as text, keys sorted."""
    of = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    first, second = of(a), of(b)
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, second)))))


def to_enum(c: Column, labels: list[str]) -> Column:
    """The text if it is one of the labels, else null."""
    return F.when(c.isin(*labels), c)


def to_uuid(c: Column) -> Column:
    """32 hexadecimal digits, with or without dashes, in the canonical form; anything else is null."""
    h = F.lower(F.replace(c, F.lit("-"), F.lit("")))
    parts = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(h.rlike("^[0-9a-f]{32}$"), parts)
