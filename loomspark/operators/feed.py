"""One feed over sources of unlike shape: each gives its newest rows in one form, what is its own goes into a VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

#: Characters of a title and of a detail, and the bounds of how many rows a feed has.
TITLE, DETAIL, LEAST, MOST = 80, 200, 1, 200


def moment(rows: DataFrame, column: str) -> Column:
    """A time without zone from a time, a number of seconds since 1970 or an ISO text; null where there is none. Zero is none."""
    kind, value = rows.schema[column].dataType, F.col(column)
    if isinstance(kind, NumericType):
        seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), value.cast("decimal(18,6)"))
        return F.when(value != 0, F.lit("1970-01-01").cast("timestamp_ntz") + seconds)
    if isinstance(kind, StringType):
        return value.try_cast("timestamp_ntz")
    return value.cast("timestamp_ntz")


def source(rows: DataFrame, kind: str, key: str, ts: str, last: int, title: Column, detail: Column, sub_kind: Column, meta: str) -> DataFrame:
    """The newest ``last`` rows as kind, id, ts, title, detail, sub_kind, meta. Rows without a time take no part.

    meta names a struct column, or one of JSON text, which is null where it doesn't parse. Equal times go by id, the larger first.
    """
    is_struct = isinstance(rows.schema[meta].dataType, StructType)
    parsed = F.to_variant_object(F.col(meta)) if is_struct else F.try_parse_json(F.col(meta).cast("string"))
    items = rows.select(
        F.lit(kind).alias("kind"), F.concat_ws("-", F.lit(kind), F.col(key).cast("string")).alias("id"), moment(rows, ts).alias("ts"),
        F.left(title, F.lit(TITLE)).alias("title"), F.left(detail, F.lit(DETAIL)).alias("detail"), sub_kind.alias("sub_kind"), parsed.alias("meta"),
    )
    return items.where("ts is not null").orderBy(F.desc("ts"), F.desc("id")).limit(last)


def activity(sources: list[DataFrame], limit: int = 50, kind: str | None = None) -> DataFrame:
    """The newest rows of all sources, of one kind if asked for, between LEAST and MOST of them.

    The kind is tested before the limit, so that a rare one is found behind any number of others. Sources hand in their newest
    rows alone, so what is sorted here is bounded by their number.
    """
    feed = reduce(DataFrame.unionByName, sources)
    if kind and kind.strip():
        feed = feed.where(F.col("kind") == kind.strip().lower())
    return feed.orderBy(F.desc("ts"), "kind", "id").limit(max(LEAST, min(limit, MOST)))
