"""Running sums along an order, for keys of any number of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import materialize


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """All keys equal, nulls counting as equal."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def running(df: DataFrame, key: list[str], order: list[Column], sums: dict[str, Column], *, totals: bool = False,
            maxima: dict[str, Column] | None = None, block: int | None = None) -> DataFrame:
    """``df`` with the running sum of every named value, up to and including the row, in ``order``
    within ``key``; ``totals`` adds ``<name>_total`` over the whole key, ``maxima`` named maxima over it.

    The rows are dealt out by ranges of key and order, so a range holds about as many rows as any
    other, whatever the values of the order and however many rows a key has. A range is summed on
    its own; of the keys that go on from one range to the next (one per range at most, which
    bounds what is broadcast) the sums of the earlier ranges are added. Rows of equal order come
    in any order. ``block`` aims at a number of rows per range; without it the session's number
    of shuffle partitions counts.
    """
    maxima = maxima or {}
    parts = [max(1, -(-df.count() // block))] if block else []
    value = {f"_v_{n}": c for n, c in {**sums, **maxima}.items()}
    rows = materialize(df.withColumns(value).repartitionByRange(*parts, *[F.col(k) for k in key], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    runs = rows.groupBy(*key, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_m_{n}") for n in maxima])
    whole = Window.partitionBy(*key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    across = runs.withColumn("_ranges", F.count(F.lit(1)).over(whole)).filter("_ranges > 1").select(
        *key, "_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(f"_t_{n}") for n in sums], *[F.max(f"_m_{n}").over(whole).alias(f"_k_{n}") for n in maxima])
    own = Window.partitionBy("_part", *key)
    so_far = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({**{n: F.sum(f"_v_{n}").over(so_far) for n in sums}, **({f"{n}_total": F.sum(f"_v_{n}").over(own) for n in sums} if totals else {}),
                              **{n: F.max(f"_v_{n}").over(own) for n in maxima}})
    joined = local.join(F.broadcast(across), (local["_part"] == across["_part"]) & same(local, across, key), "left")
    names = [c for c in df.columns if c not in sums and c not in maxima]
    return joined.select(*[local[c] for c in names], *[(local[n] + F.coalesce(across[f"_o_{n}"], F.lit(0))).alias(n) for n in sums],
                         *([F.coalesce(across[f"_t_{n}"], local[f"{n}_total"]).alias(f"{n}_total") for n in sums] if totals else []),
                         *[F.coalesce(across[f"_k_{n}"], local[n]).alias(n) for n in maxima])
