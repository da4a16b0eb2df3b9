"""Column expressions over survey data: labels, slots, dummies, units, projection texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions import cells, registry


def label(code: Column, names: dict[int, str]) -> Column:
    """A code's name, or unknown(code)."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.concat(F.lit("unknown("), code.cast("string"), F.lit(")")))


def type_label(code: Column) -> Column:
    return F.when(code < 0, F.concat(F.lit("string["), (-code).cast("string"), F.lit("]"))).otherwise(label(code, cells.TYPE_NAMES))


def line_slot(blob_index: Column, chans_max: Column) -> Column:
    """Floor division: an index below 0 is on a line below 0."""
    return F.floor(blob_index / chans_max).cast("long")


def channel_slot(blob_index: Column, chans_max: Column) -> Column:
    return F.pmod(blob_index, chans_max)


def blob_index(line: Column, channel: Column, chans_max: Column) -> Column:
    return line * chans_max + channel


def is_live(word: Column) -> Column:
    return word.bitwiseAND(F.lit(0x80000000)) != 0


def start_page(word: Column) -> Column:
    return word.bitwiseAND(F.lit(0x3FFFFFFF))


def without_dummy(value: Column, type_code: int) -> Column:
    """Null where the value is what marks missing data in its stored type; a float's mark is compared as a float."""
    mark = F.lit(cells.dummy(type_code))
    return F.nullif(value, mark.cast("float") if type_code == 4 else mark)


def timestamp(raw: Column) -> Column:
    return F.timestamp_seconds(F.nullif(raw.cast("long"), F.lit(-(2**31))))


def arc_seconds(radians: Column) -> Column:
    return F.degrees(radians) * 3600


def parts_per_million(scale: Column) -> Column:
    return (scale - 1) * 1e6


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b))


def projection_method(text: Column) -> Column:
    """The quoted method of ``"Method",p1,p2,...``; null if the text isn't of that form or a parameter is no number."""
    good = text.rlike(r'^\s*"[^"]*"\s*(,.*)?$') & ~F.exists(_parts(text), lambda x: x.try_cast("double").isNull())
    return F.when(good, F.regexp_extract(text, r'^\s*"([^"]*)"', 1))


def _parts(text: Column) -> Column:
    rest = F.regexp_extract(text, r'^\s*"[^"]*"\s*,(.*)$', 1)
    return F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(rest, ","), lambda x: F.trim(x)))


def projection_values(text: Column) -> Column:
    return F.when(projection_method(text).isNotNull(), F.transform(_parts(text), lambda x: x.try_cast("double")))


def holds_in_order(values: Column, slots: Column) -> Column:
    """Whether the values are the slots that are set, in order, within the tolerance."""
    used = F.filter(slots, lambda x: x.isNotNull())
    return (F.size(values) == F.size(used)) & F.forall(F.zip_with(values, used, close), lambda x: F.coalesce(x, F.lit(False)))


def parameter_names(method: Column) -> Column:
    table = F.create_map(*[x for k, v in registry.PARAMETERS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]).cast("array<string>"))])
    return F.try_element_at(table, method)


def flattened(column: str, width: int, name: str | None = None) -> list[Column]:
    """A column for each element of an array column: name[0], name[1], ..."""
    return [F.get(F.col(f"`{column}`"), j).alias(f"{name or column}[{j}]") for j in range(width)]


def rows_of(flat: Column, width: int) -> Column:
    """A flat array as an array of rows of ``width``; a ragged tail is dropped."""
    n = F.floor(F.size(flat) / width).cast("int")
    return F.when(n < 1, F.array()).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * width + 1, width)))
