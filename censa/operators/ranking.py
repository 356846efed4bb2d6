"""Ranks, percentiles, running sums and top rows, by group where a group is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written


def average_rank(value: str, *group: str) -> Column:
    """1-based rank, ties sharing their mean rank."""
    w = Window.partitionBy(*group)
    same = Window.partitionBy(*group, value)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(same) - 1) / 2


def percent_of_rank(value: str, *group: str) -> Column:
    """Average rank over the number of rows."""
    return average_rank(value, *group) / F.count(F.lit(1)).over(Window.partitionBy(*group))


def rank01(value: str, tie: list[str], *group: str) -> Column:
    """Place from 0 to 1, ties in the order given."""
    w = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    return F.when(n > 1, (F.row_number().over(w.orderBy(value, *tie)) - 1) / (n - 1)).otherwise(0.0)


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds `_b`: rows in ranges of about equal numbers, numbered in the order given; written, so that the numbers stay.

    The cuts come from a sample of the rows, as for a sorted table, so they follow the data: one outlier, a heavy tail or a
    hot value costs nothing, as long as the order tells rows apart. There are as many ranges as shuffle partitions. A Spark
    job runs while the plan is made.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_b", F.spark_partition_id()))


def prefix_sums(df: DataFrame, group: list[str], order: list[Column | str], **sums: Column) -> DataFrame:
    """Adds for each name in `sums` its sum over the rows of the group up to this one, and the group's total as name_all.

    Rows are dealt to ranges over (group, order): a large group takes many ranges, many small ones share one. The ranges'
    totals, as many as ranges and groups, are summed first, then rows within ranges, so that no task holds a group.
    Rows that the order does not tell apart come in any order.
    """
    rows = in_ranges(df.select("*", *(x.alias(f"_s_{n}") for n, x in sums.items())), *group, *order)
    total = rows.groupBy("_b", *group).agg(*(F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_g{k}" for k in range(len(group))]
    total = total.select(
        F.col("_b").alias("_o"), *(F.col(g).alias(n) for g, n in zip(group, names, strict=True)),
        *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums), *(F.sum(f"_t_{n}").over(whole).alias(f"{n}_all") for n in sums),
    )
    upto = Window.partitionBy("_b", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*df.columns, "_b", *(F.sum(f"_s_{n}").over(upto).alias(f"_s_{n}") for n in sums))
    on = F.col("_b") == F.col("_o")
    for g, n in zip(group, names, strict=True):
        on = on & F.col(g).eqNullSafe(F.col(n))
    return rows.join(total, on).select(*df.columns, *((F.col(f"_s_{n}") + F.col(f"_t_{n}")).alias(n) for n in sums), *(f"{n}_all" for n in sums))


def running(df: DataFrame, value: str, tie: str, falling: bool = False, **sums: Column) -> DataFrame:
    """`prefix_sums` over all rows by value and tie. Rows equal in both come in any order, and are dealt out like others."""
    first = F.col(value).desc() if falling else F.col(value).asc()
    return prefix_sums(df.withColumn("_any", F.rand(0)), [], [first, F.col(tie), F.col("_any")], **sums).drop("_any")


def value_at(df: DataFrame, value: str, share: float, out: str) -> DataFrame:
    """One row: the element at floor(share (n - 1)) of all values in order; empty tables give null."""
    return quantile_at(df, [], value, share, out)


def quantile_at(df: DataFrame, key: list[str], value: str, share: float, out: str) -> DataFrame:
    """(key, out): the element at floor(share (n - 1)) of each key's values in order, nulls left out.

    Equal values are counted first, and the counts of distinct values are summed up.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = prefix_sums(counts, key, [F.col(value)], _upto=F.col("_c"))
    place = F.floor(F.lit(share) * (F.col("_upto_all") - 1))
    one = ranked.where((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place))
    return one.groupBy(*key).agg(F.min(value).alias(out))


def global_places(df: DataFrame, value: str, tie: list[str]) -> DataFrame:
    """Adds `place` (from 0) and `rows`: the order of all rows by value and tie, without bringing rows to one task. Null comes first, NaN last."""
    out = prefix_sums(df, [], [F.col(value), *(F.col(t) for t in tie)], place=F.lit(1).cast("long"))
    return out.withColumn("place", F.col("place") - 1).withColumnRenamed("place_all", "rows")


def places_beside(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Adds for each name in `values` the place from 0 to 1 of that column's number among all rows.

    Equal values share their mean place, a null or NaN comes before all numbers, and a single row has place 0. Counts of
    distinct values of all columns are summed up in one pass. The places of a column's values are a table of their own: rows
    are not moved to meet a small one, and move once to meet a large one.
    """
    number = lambda v: F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
    counts = df.select(F.posexplode(F.array(*(number(v) for v in values.values()))).alias("factor", "x")).groupBy("factor", "x").agg(F.count(F.lit(1)).alias("c"))
    upto = prefix_sums(counts, ["factor"], [F.col("x")], n=F.col("c"))
    place = (F.col("n") - F.col("c") + (F.col("c") - 1) / 2) / F.greatest(F.col("n_all") - 1, F.lit(1))
    for k, (name, value) in enumerate(values.items()):
        ahead = written(upto.where(F.col("factor") == k).select(F.col("x").alias("_x"), place.alias(name)))
        df = df.join(ahead, number(value).eqNullSafe(F.col("_x"))).drop("_x")
    return df


def each_place(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, factor, place): `places_beside` as a row for each row and column; `factor` counts the columns from 0."""
    names = [f"_place{k}" for k in range(len(values))]
    rows = places_beside(df.select(*dict.fromkeys([*key, *values])), dict(zip(names, values, strict=True)))
    return rows.select(*key, F.posexplode(F.array(*names)).alias("factor", "place"))


def average_places(df: DataFrame, value: str, out: str, share: bool = False) -> DataFrame:
    """Adds the average rank (from 1) of a number among all rows, or its share of their number; distinct values are ranked, not rows.

    Rows without a value are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = prefix_sums(counts, [], [F.col("_v")], c=F.col("_n"))
    rank = F.col("c") - (F.col("_n") - 1) / 2
    return df.join(upto.select("_v", (rank / F.col("c_all") if share else rank).alias(out)), F.col(value) == F.col("_v")).drop("_v")


def percent_of_all(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the average rank of a number among all rows over their number. Rows without a value are left out."""
    return average_places(df, value, out, share=True)


def size_percentile(df: DataFrame, value: str, tie: list[str]) -> DataFrame:
    """Adds `pct`: 100 place / (n - 1) among rows with a finite value; others get null."""
    fine = F.col(value).isNotNull() & ~F.isnan(value)
    placed = global_places(df.where(fine), value, tie).withColumn("pct", 100.0 * F.col("place") / F.greatest(F.col("rows") - 1, F.lit(1))).drop("place", "rows")
    return placed.unionByName(df.where(~fine).withColumn("pct", F.lit(None).cast("double")))


def first_per(df: DataFrame, key: list[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def coverage(df: DataFrame, query: str, confidence: str, tie: str, target: float, most: int) -> DataFrame:
    """The fewest candidates of each query whose confidence adds up to the target share of the total, at most `most`."""
    w = Window.partitionBy(query)
    order = w.orderBy(F.col(confidence).desc(), tie)
    before = F.coalesce(F.sum(confidence).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = df.select("*", F.row_number().over(order).alias("rank"), before.alias("_before"), F.sum(confidence).over(w).alias("_total"))
    return out.where((F.col("rank") == 1) | ((F.coalesce(F.try_divide("_before", "_total"), F.lit(0.0)) + 1e-9 < target) & (F.col("rank") <= most))).drop("_before", "_total")


def running_prf(df: DataFrame, group: list[str], score: str, truth: str, tie: str) -> DataFrame:
    """Running tp and fp by falling score, with precision and recall; a group is summed in ranges, not in one task."""
    hit = F.col(truth).cast("int")
    out = prefix_sums(df, group, [F.col(score).desc(), F.col(tie)], tp=hit, fp=1 - hit).withColumnRenamed("tp_all", "positives").drop("fp_all")
    return out.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0))


def top_two(df: DataFrame, query: str, score: str, candidate: str) -> DataFrame:
    """(query, best, top1, top2, margin): top2 is 0 for a single candidate."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), candidate))).where("_k <= 2")
    out = ranked.groupBy(query).agg(F.max(F.when(F.col("_k") == 1, F.col(candidate))).alias("best"), F.max(F.when(F.col("_k") == 1, F.col(score))).alias("top1"), F.coalesce(F.max(F.when(F.col("_k") == 2, F.col(score))), F.lit(0.0)).alias("top2"))
    return out.withColumn("margin", F.col("top1") - F.col("top2"))
