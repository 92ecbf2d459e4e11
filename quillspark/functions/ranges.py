"""Order over a distributed table without a window over all of it: ranges of an order, running sums, neighbours, percentiles.

A window over a hot group, or over a whole table, is one task. Here rows get a range of their order first; totals per group
and range (few rows) give each range what lies before it, and windows then see one group's one range at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a table, and rows that are looked at to cut them; the rows only decide how even the ranges are.
RANGES, LOOKED = 64, 6400


def with_range(df: DataFrame, order: list[str], name: str = "_range", ranges: int = RANGES, looked: int = LOOKED) -> DataFrame:
    """df with a range number that never falls along the order (nulls first). Equal keys share a range.

    The cuts come from the rows of least hash, so they are the same in every run over the same rows.
    """
    key = F.struct(*order)
    seen = [r[0] for r in df.select(key.alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(looked).collect()]
    some = df.sparkSession.createDataFrame([(x,) for x in seen], df.select(key.alias("k")).schema).orderBy("k").collect() if seen else []
    cuts = sorted({len(some) * k // ranges for k in range(1, ranges)} - {0})
    kind = df.select(key.alias("k")).schema["k"].dataType
    at = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(some[c][0], kind.fields))) for c in cuts)) if cuts else None
    return df.withColumn(name, F.size(F.filter(at, lambda c: c <= key)) if cuts else F.lit(0))


def _equal(cols: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cols]


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """Running totals, this row included, of sums (new column -> what is added up) in the order, for each group of by (maybe none).

    order must tell rows of a group apart. The table is cut into ranges, whose totals are added up in a window over groups x ranges rows.
    """
    ranged = with_range(df.withColumns({f"_s_{n}": c for n, c in sums.items()}), order, ranges=ranges)
    at = [*by, "_range"]
    totals = ranged.groupBy(*at).agg(*(F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(c).alias(f"_k_{c}") for c in at), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, _equal(at))
    return joined.withColumns({n: F.col(f"_o_{n}") + F.coalesce(F.sum(f"_s_{n}").over(inside), F.lit(0)) for n in sums}).drop(*(f"{p}_{n}" for p in ("_o", "_s") for n in sums), *(f"_k_{c}" for c in at), "_range")


def neighbours(df: DataFrame, by: list[str], order: list[str], values: list[str], ranges: int = RANGES) -> DataFrame:
    """df with prev and next: structs of values of the row before and after in its group, or null.

    Rows at a range's borders take what the nearest range with rows of the group has at its end or start.
    """
    ranged = with_range(df, order, ranges=ranges)
    at, own, key = [*by, "_range"], F.struct(*values), F.struct(*order)
    ends = ranged.groupBy(*at).agg(F.min_by(own, key).alias("_first"), F.max_by(own, key).alias("_last"))
    along = Window.partitionBy(*by).orderBy("_range")
    borders = ends.select(*(F.col(c).alias(f"_k_{c}") for c in at), F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    inside = Window.partitionBy(*at).orderBy(*order)
    placed = ranged.withColumns({"_v": own}).withColumns({"_p": F.lag("_v").over(inside), "_n": F.lead("_v").over(inside), "_a": F.row_number().over(inside), "_z": F.lead(F.lit(1)).over(inside)})
    joined = placed.join(borders, _equal(at))
    prev = F.when(F.col("_a") == 1, F.col("_before")).otherwise(F.col("_p"))
    following = F.when(F.col("_z").isNull(), F.col("_after")).otherwise(F.col("_n"))
    return joined.withColumns({"prev": prev, "next": following}).drop("_v", "_p", "_n", "_a", "_z", "_before", "_after", *(f"_k_{c}" for c in at), "_range")


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group: exact percentiles (between neighbours by interpolation) of a numeric column, nulls aside.

    Equal values are counted before anything moves, so a group's work is its distinct values; their counts are running
    totals over ranges of the value.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = running(counted, by, [value], {"_u": F.col("_c")})
    total = counted.groupBy(*by).agg(F.sum("_c").alias("_all"))
    joined = upto.join(total.select(*(F.col(c).alias(f"_k_{c}") for c in by), "_all"), _equal(by)) if by else upto.crossJoin(F.broadcast(total))  # one row
    cols = []
    for name, share in shares.items():
        place = (F.col("_all") - 1) * share
        low, high = F.floor(place), F.ceil(place)
        holds = lambda p: (F.col("_u") > p) & (F.col("_u") - F.col("_c") <= p)
        a, b = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
        part = F.max(place - low)
        cols.append((a + (b - a) * part).cast("double").alias(name))
    return joined.groupBy(*by).agg(*cols)
