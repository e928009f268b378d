"""Explicit order: lineage cuts, running totals and positions over a global order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame, spent: DataFrame | None = None) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    Only a local session that names no folder (tests, a notebook) gets one of its own;
    on a cluster a folder that all can see must be named. ``spent`` is a frame that this
    function returned before and that nothing but ``df`` still reads: its files go.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="trawlix-checkpoint-"))
    out = df.checkpoint(eager=True)
    if spent is not None:
        forget(spent)
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` returned; nothing may read it any more."""
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if path.isDefined():
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path.get())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def split_join(rows: DataFrame, small: DataFrame, on: list[str], how: str, spread: Column, parts: int = 16) -> DataFrame:
    """Join ``rows`` to a frame of one row a key; the rows of a key go to ``parts`` tasks by ``spread``, and the small side's row to each."""
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return salted.join(copies, [*on, "_part"], how).drop("_part")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], partitions: int | None = None, group: list[Column] | None = None) -> DataFrame:
    """Add running totals over a global order without gathering a group in one task.

    Rows are range-sorted by ``order`` (which should be total but for equal rows),
    each range is summed, and each row's running total is its range's offset plus
    the total inside the range. Only one row per range meets in a single task.
    The running totals include the row itself. Hot keys are split over ranges
    because the order's later columns take part in the range boundaries.

    With ``group`` the totals begin anew in each group, whose rows are sorted side by
    side; a group may lie over many ranges.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(sums)
    with_values = df.withColumns({f"_v_{k}": c for k, c in sums.items()})
    keyed = with_values.withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*(group or []), *order])]))
    if group:
        keyed = keyed.withColumn("_group", F.struct(*[c.alias(f"g{i}") for i, c in enumerate(group)]))
    ranged = cut(keyed.repartitionByRange(n, "_order").withColumns({"_range": F.spark_partition_id(), "_tie": F.monotonically_increasing_id()}))
    within = ["_range", "_group"] if group else ["_range"]
    totals = ranged.groupBy(*within).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in names])
    before = (Window.partitionBy("_group") if group else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*within, *[F.sum(f"_t_{k}").over(before).alias(f"_b_{k}") for k in names])
    inside = Window.partitionBy(*within).orderBy("_order", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({k: F.sum(f"_v_{k}").over(inside) for k in names})
    # One row per range, a fixed setting: a range goes on with one group at most.
    begun = offsets.where(F.coalesce(*[F.col(f"_b_{k}") for k in names]).isNotNull())
    if group:
        begun = begun.withColumnRenamed("_group", "_on")
    joined = summed.join(F.broadcast(begun), "_range", "left")
    carry = lambda k: F.when(F.col("_on").eqNullSafe(F.col("_group")), F.col(f"_b_{k}")) if group else F.col(f"_b_{k}")
    out = joined.withColumns({k: F.col(k) + F.coalesce(carry(k), F.lit(0)) for k in names})
    return out.drop("_order", "_range", "_tie", "_group", "_on", *[f"_v_{k}" for k in names], *[f"_b_{k}" for k in names])


def with_positions(df: DataFrame, order: list[Column], name: str = "pos", group: list[Column] | None = None) -> DataFrame:
    """Add the row's place (from 0) in the global order, or in its group's."""
    return prefix_sums(df, order, {name: F.lit(1)}, group=group).withColumn(name, F.col(name) - 1)
