"""Front matter of notes as Column expressions: text -> (meta map, body)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: A field: its key, its value on the same line, and the list items (or blank lines) that follow it directly.
FIELD = r"(?Um)^([\w-]+):[ \t]*([^\r\n]*)((?:\r?\n[ \t]*(?=\r|\n|\z)|\r?\n[ \t]+-[ \t]+[^\r\n]*)*)"
ITEM = r"(?m)^[ \t]+-[ \t]+([^\r\n]*)$"


def _bare(value: Column) -> Column:
    for marks in (" \t\r", '"', "'", " \t\r"):
        value = F.btrim(value, F.lit(marks))
    return value


def _some(values: Column) -> Column:
    return F.filter(F.transform(values, _bare), lambda v: v != "")


def _value(line: Column, items: Column) -> Column:
    whole = _bare(line)
    listed = F.split(F.substr(whole, F.lit(2), F.greatest(F.length(whole) - 2, F.lit(0))), ",", -1)
    own = F.when(whole.rlike(r"^\[.*\]$"), listed).otherwise(F.array(whole))
    return F.array_join(F.concat(_some(own), _some(F.regexp_extract_all(items, F.lit(ITEM), F.lit(1)))), ", ")


def front_matter(text: Column | str) -> Column:
    """struct<meta: map, body>: a block between --- lines at the start, its values flat, lists joined by ", ".

    A key that comes again takes the later value. Without a closed block (or for null) meta is empty and the body the text.
    """
    text = F.col(text) if isinstance(text, str) else text
    end = F.locate("\n---", text, 4)
    closed = F.startswith(text, F.lit("---")) & (end > 0)
    head = F.substr(text, F.lit(4), end - 4)
    keys, lines, items = (F.regexp_extract_all(head, F.lit(FIELD), F.lit(g)) for g in (1, 2, 3))
    fields = F.reverse(F.zip_with(F.arrays_zip(keys.alias("k"), lines.alias("v")), items, lambda f, i: F.struct(f["k"].alias("key"), _value(f["v"], i).alias("value"))))
    named = F.struct(fields.alias("fields"), F.reverse(keys).alias("names"))
    latest = let(named, lambda n: F.filter(n["fields"], lambda f, i: F.array_position(n["names"], f["key"]) == i + 1))
    none = F.create_map().cast("map<string,string>")
    meta = F.when(closed, F.map_from_entries(F.reverse(latest))).otherwise(none)
    return F.struct(meta.alias("meta"), F.when(closed, F.substring(text, end + 4, F.length(text))).otherwise(text).alias("body"))
