"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.storage import written


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add a row number from 0 in the given order.

    Range-partitioned and written with its partition number, so that numbers inside partitions plus the counts
    of those before give the rank; only one count for each partition reaches the driver.
    """
    spark = df.sparkSession
    part, base = f"_{name}_part", f"_{name}_base"
    dealt = written(df.repartitionByRange(*[F.col(x) for x in order]).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy(part).count().collect())
    total, bases = 0, []
    for p, n in sizes:
        bases.append((p, total))
        total += n
    offsets = spark.createDataFrame(bases, f"{part} int, {base} long")
    w = Window.partitionBy(part).orderBy(*order)
    return (dealt.withColumn(name, F.row_number().over(w) - 1).join(F.broadcast(offsets), part)
            .withColumn(name, F.col(name) + F.col(base)).drop(part, base))
