"""Events kept small enough to stand in a stream: values bounded level by level by their type, then three shrinking passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from loomspark.functions.arrays import let, let_all

#: Characters of the message and of any other text, items of a list, keys of an inner map, fields of an event,
#: bytes of the whole, the fields that are never dropped, and the frame marks that must not occur inside an event.
MESSAGE, FIELD, LIST, INNER, FIELDS, BYTES = 420, 180, 12, 16, 24, 4096
KEPT = ("step", "message", "tool", "step_id", "plan_id")
MARKS = ("STATUS", "STATUS_END", "ERROR", "ERROR_END", "SECTION_START", "SECTION_END")
#: Characters of a kept field in the last pass: five of them fit even if each character is escaped to six bytes.
SHORTEST = 60


def cut(text: Column, most: int) -> Column:
    """The text, or its beginning with a mark, in at most that many characters. Cutting twice changes nothing."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def bounded(value: Column, kind: DataType, most: int = FIELD) -> Column:
    """The value with every text, list and map in it bounded, however deep its type is; other values stay, nulls stay null.

    The type is walked when the expression is built, so a task does nothing but the slices and cuts.
    """
    if isinstance(kind, StringType):
        return cut(value, most)
    if isinstance(kind, ArrayType):
        return F.transform(F.slice(value, 1, LIST), lambda x: bounded(x, kind.elementType, most))
    if isinstance(kind, MapType):

        def entry(e: Column) -> Column:
            return F.struct(e["key"].alias("key"), bounded(e["value"], kind.valueType, most).alias("value"))

        return F.map_from_entries(F.transform(F.slice(F.map_entries(value), 1, INNER), entry))
    if isinstance(kind, StructType):
        inner = [bounded(value[f.name], f.dataType, most).alias(f.name) for f in kind.fields[:INNER]]
        return F.when(value.isNotNull(), F.struct(*inner))
    return value


def _json(value: Column, kind: DataType) -> Column:
    """JSON of one value; a text or number is wrapped in a list and taken out again."""
    if isinstance(kind, ArrayType | MapType | StructType):
        return F.to_json(value)
    return let(F.to_json(F.array(value)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def _entry(key: Column, json: Column, is_list: bool, text: Column) -> Column:
    kept = key.isin(*KEPT)
    return F.struct(key.alias("key"), json.alias("json"), F.lit(is_list).alias("list"), kept.alias("kept"), text.alias("text"))


def _object(entries: Column) -> Column:
    """JSON object of the entries in order; an underscore that would open a frame mark is escaped."""
    parts = F.transform(entries, lambda e: F.concat(_json(e["key"], StringType()), F.lit(": "), e["json"]))
    plain = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    return F.regexp_replace(plain, f"_(?=_(?:{'|'.join(MARKS)})__)", r"\\u005f")


def _limited(entries: Column) -> Column:
    """At most FIELDS entries: kept ones first, then the first others; how many were too many is a field of its own."""

    def parted(v: Column) -> Column:
        kept = F.filter(v["all"], lambda e: e["kept"])
        first = F.filter(F.slice(v["all"], F.lit(1), FIELDS - F.size(kept)), lambda e: ~e["kept"])
        more = (F.size(v["all"]) - FIELDS).cast("string")
        return F.when(F.size(v["all"]) <= FIELDS, v["all"]).otherwise(
            F.concat(kept, first, F.array(_entry(F.lit("fields_dropped"), more, False, more)))
        )

    return let_all({"all": entries}, parted)


def encoded(fields: dict[str, tuple[Column, DataType]], extra: Column | None = None) -> Column:
    """Struct (passes, event): the event as JSON of at most BYTES bytes, and how many passes it took.

    fields: name to column and its type, in order; a null column is no field. extra: a map of further text fields, those with
    the name of a field left out. Pass 1 is the bounded event; 2 leaves out its lists; 3 keeps KEPT as short texts; 4 cuts those
    further, which is the end, as five texts of SHORTEST characters always fit.
    """
    entries = []
    for name, (value, kind) in fields.items():
        small = bounded(value, kind, MESSAGE if name == "message" else FIELD)
        text = F.to_json(small) if isinstance(kind, ArrayType | MapType | StructType) else small.cast("string")
        entry = _entry(F.lit(name), _json(small, kind), isinstance(kind, ArrayType), text)
        entries.append(F.when(value.isNotNull(), entry))
    listed = F.filter(F.array(*entries), lambda e: e.isNotNull())
    if extra is not None:
        others = F.filter(F.map_entries(extra), lambda e: ~e["key"].isin(*fields))

        def other(e: Column) -> Column:
            text = cut(e["value"], FIELD)
            return _entry(e["key"], F.coalesce(_json(text, StringType()), F.lit("null")), False, text)

        listed = F.concat(listed, F.coalesce(F.transform(others, other), F.array().cast(_ENTRIES)))

    def short(e: Column, most: int) -> Column:
        text = cut(e["text"], most)
        return _entry(e["key"], F.coalesce(_json(text, StringType()), F.lit("null")), False, text)

    def shrunk(v: Column) -> Column:
        kept = F.filter(v["e"], lambda e: e["kept"])
        passes = [
            _object(v["e"]),
            _object(F.filter(v["e"], lambda e: ~e["list"])),
            _object(F.transform(kept, lambda e: short(e, FIELD))),
            _object(F.transform(kept, lambda e: short(e, SHORTEST))),
        ]
        told = [F.struct(F.lit(n).alias("passes"), p.alias("event")) for n, p in enumerate(passes, 1)]
        fits = lambda this, then: let(this, lambda t: F.when(F.octet_length(t["event"]) <= BYTES, t).otherwise(then))
        return reduce(lambda then, this: fits(this, then), reversed(told[:-1]), told[-1])

    return let_all({"e": _limited(listed)}, shrunk)


_ENTRIES = "array<struct<key:string,json:string,list:boolean,kept:boolean,text:string>>"
