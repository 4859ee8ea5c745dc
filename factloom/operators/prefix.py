"""Running sums without a task that sees a whole group.

Rows are put in ranges of (group, order) and written so; each range adds up its own rows, and
starts from what the ranges before it have of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def running(rows: DataFrame, groups: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """rows with a column for each of sums: its total over the rows of the group up to this one, in order.

    Rows that tie in order are added one after the other, in any order.  A null counts as nothing.
    """
    at, adds = "__range", {name: F.coalesce(c, F.lit(0)) for name, c in sums.items()}
    own = {name: f"__{name}" for name in sums}
    ranged = rows.withColumns({own[name]: c for name, c in adds.items()}).repartitionByRange(*groups, *order).withColumn(at, F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    totals = ranged.groupBy(*groups, at).agg(*(F.sum(own[name]).alias(f"__before_{name}") for name in sums))
    if groups:  # a group has one row for each of its ranges here
        before = Window.partitionBy(*groups).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumns({f"__before_{name}": F.sum(f"__before_{name}").over(before) for name in sums})
    else:  # one row for each range, at most as many as a shuffle has partitions
        found, so_far, offsets = sorted(totals.collect(), key=lambda r: r[at]), [0] * len(sums), []
        for r in found:
            offsets.append((r[at], *so_far))
            so_far = [a + r[f"__before_{name}"] for a, name in zip(so_far, sums, strict=True)]
        totals = rows.sparkSession.createDataFrame(offsets, totals.schema)
    keys = [*groups, at]
    same = None
    for k in keys:
        one = ranged[k].eqNullSafe(totals[k])
        same = one if same is None else same & one
    inside = Window.partitionBy(*(ranged[k] for k in keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(totals, same, "left")
    out = [F.coalesce(F.col(f"__before_{name}"), F.lit(0)) + F.sum(own[name]).over(inside) for name in sums]
    return joined.select(*(ranged[c] for c in rows.columns if c not in sums), *(c.alias(name) for c, name in zip(out, sums, strict=True)))
