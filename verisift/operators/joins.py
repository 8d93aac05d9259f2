"""Joins that choose between broadcast and a salted shuffle by the counted size of one side."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.session import cut_lineage

#: A side is broadcast only when it was counted and has at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Beyond that, the rows of a key of the large side are spread over one task for each so many of them.
KEY_ROWS = 200_000
#: Most keys that are spread; others have at most this part of all rows.
HOT_KEYS = 10_000
#: Tasks over which rows with a null in the key are spread; they match nothing.
NULL_SPREAD = 1 << 16


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes; 0 for null."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(value).cast("long")
    elif isinstance(kind, T.ArrayType):
        zero = F.lit(16).cast("long")
        size = F.aggregate(value, zero, lambda total, v: total + value_bytes(v, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((value_bytes(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    else:
        size = F.lit(8).cast("long")
    return F.coalesce(size, F.lit(0).cast("long"))


def fits_broadcast(small: DataFrame, broadcast_rows: int | None = None, broadcast_bytes: int | None = None) -> bool:
    """Whether ``small``, which is counted and measured by partial sums, is small enough to be broadcast."""
    most = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if most < 0:
        return False
    size = sum((value_bytes(small[f.name], f.dataType) + 16 for f in small.schema.fields), F.lit(0).cast("long"))
    found = small.agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).collect()[0]
    return found["rows"] <= most and (found["bytes"] or 0) <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)


def hot_keys(large: DataFrame, on: list[str], key_rows: int | None = None) -> DataFrame:
    """(on, tasks): the keys with more rows in ``large`` than one task should get, and how many tasks they
    need. As each has more than a part of all rows, there are at most HOT_KEYS of them."""
    counts = cut_lineage(large.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("rows")))
    total = counts.agg(F.sum("rows").alias("rows")).collect()[0]["rows"] or 0
    most = max(KEY_ROWS if key_rows is None else key_rows, -(-total // HOT_KEYS))
    return counts.where(F.col("rows") > most).select(*on, F.ceil(F.col("rows") / F.lit(most)).cast("int").alias("tasks"))


def sized_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    broadcast_rows: int | None = None,
    key_rows: int | None = None,
) -> DataFrame:
    """Join ``large`` with ``small`` on ``on`` (inner, left, left_semi or left_anti).

    ``small`` should be cut (checkpointed) or cheap: it is counted and measured. Up to ``broadcast_rows`` rows
    (BROADCAST_ROWS where not given) and BROADCAST_BYTES it is broadcast. Beyond, both sides are shuffled on the
    key and a salt: the keys of ``large`` are counted, and a key gets a salt for each ``key_rows`` of its rows
    (KEY_ROWS where not given), for which the rows of ``small`` are repeated, so that no key, however hot, has
    to fit one task. Rows with nulls in the key match nothing and are spread evenly.
    """
    if fits_broadcast(small, broadcast_rows):
        return large.join(F.broadcast(small), on, how)
    salt, tasks = "_salt", "_tasks"
    hot = F.broadcast(hot_keys(large, on, key_rows).withColumnRenamed("tasks", tasks))  # at most HOT_KEYS
    hashed = [large[c] for c, kind in large.dtypes if "map<" not in kind and "variant" not in kind]
    # the partition is the same in every try of a task, and tells equal rows apart
    draw = F.xxhash64(*hashed, F.spark_partition_id())
    null = reduce(or_, [F.col(c).isNull() for c in on])
    many = F.when(null, F.lit(NULL_SPREAD)).otherwise(F.coalesce(F.col(tasks), F.lit(1)))
    drawn = large.withColumn("_draw", draw).join(hot, on, "left")
    spread = drawn.withColumn(salt, F.pmod("_draw", many).cast("int")).drop("_draw", tasks)
    last = F.coalesce(F.col(tasks), F.lit(1)) - 1
    copies = small.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), last))).drop(tasks)
    return spread.join(copies, [*on, salt], how).drop(salt)
