"""Case order without a task that sees all cases: data range-partitioned by the order, stored once, then numbered.

A plan that is evaluated twice may draw its ranges differently each time, so what
numbers, lags and running sums are derived from is written first. Each stored row has
``__id``, which ascends in case order and tells its part (the high bits) and its
place there (the low 33 bits).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE = (1 << 33) - 1
#: Bytes of input, by the optimiser's estimate, up to which distinct values are cumulated by one window without groups.
SMALL = 1 << 30


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; one of our own where a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillstat-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part() -> Column:
    return F.shiftright("__id", 33)


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, stored, with ``__id``. Cases that tie in the order get one of their possible places, the same from then on."""
    return store(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ordered")


def numbered(rows: DataFrame, into: str = "__case") -> DataFrame:
    """Placed rows with 1, 2, ... in case order."""
    sizes = rows.groupBy(part().alias("__part")).agg((F.max(F.col("__id").bitwiseAND(_PLACE)) + 1).alias("__n"))
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__off"))
    both = rows.withColumn("__part", part()).join(F.broadcast(offsets), "__part")
    return both.withColumn(into, F.col("__off") + F.col("__id").bitwiseAND(_PLACE) + 1).drop("__part", "__off")


def lagged(rows: DataFrame, values: dict[str, Column], n: int = 1) -> DataFrame:
    """Numbered rows (``__case``) with, for each name of ``values``, its value n cases before; a join by case number."""
    before = rows.select((F.col("__case") + n).alias("__to"), *[c.alias(name) for name, c in values.items()])
    return rows.join(before, rows["__case"] == before["__to"], "left").drop("__to")


def cumulated(rows: DataFrame, value: Column, into: str) -> DataFrame:
    """Placed rows with the sum of ``value`` up to and with each; missing values add nothing, and before the first value the sum is missing."""
    rows = rows.withColumn("__part", part()).withColumn("__value", value)
    sums = rows.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    within = F.sum("__value").over(Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0))
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    offsets = sums.select("__part", F.sum("__sum").over(above).alias("__off"))
    both = rows.withColumn("__within", within).join(F.broadcast(offsets), "__part")
    total = F.when(F.col("__within").isNull() & F.col("__off").isNull(), F.lit(None)).otherwise(F.coalesce("__within", F.lit(0)) + F.coalesce("__off", F.lit(0)))
    return both.withColumn(into, total).drop("__part", "__value", "__within", "__off")


def is_small(df: DataFrame) -> bool:
    """Whether what df reads is at most SMALL bytes by the optimiser's estimates."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) <= SMALL


def ranked(cells: DataFrame, by: list[str], x: str, weight: str, descending: bool = False) -> DataFrame:
    """Cells, one row for each value ``x`` of a group, with ``__cc`` (weight up to and with it), ``__W`` (weight of the group), ``__i`` (its number) and ``__before`` (the value before).

    Groups are windows of their own. Without groups the cells are one window only while
    they are small; beyond, they are range-partitioned and the parts' sums carried over.
    """
    order = F.col(x).desc() if descending else F.col(x).asc()
    if by or is_small(cells):
        group = Window.partitionBy(*by)
        run = group.orderBy(order)
        return cells.withColumns({"__cc": F.sum(weight).over(run.rowsBetween(Window.unboundedPreceding, 0)), "__W": F.sum(weight).over(group), "__i": F.row_number().over(run), "__before": F.lag(x).over(run)})
    rows = lagged(numbered(placed(cells, [order])), {"__before": F.col(x)})
    whole = rows.agg(F.sum(weight).alias("__W"))  # one row
    return cumulated(rows, F.col(weight), "__cc").crossJoin(F.broadcast(whole)).withColumnRenamed("__case", "__i").drop("__id")
