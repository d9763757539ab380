"""Rectangle coverages made from the tables, whose areas and overlaps have closed forms.

All coordinates are multiples of 1/64, so doubles hold them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.geometry import geo, register
from tessella.session import table


def rectangles(df: DataFrame, fid: Column, code: Column, name: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    register(df.sparkSession)
    box = F.struct(x0.cast("double").alias("xmin"), y0.cast("double").alias("ymin"), x1.cast("double").alias("xmax"), y1.cast("double").alias("ymax"))
    out = df.select(fid.cast("long").alias("fid"), code.cast("string").alias("code"), name.cast("string").alias("name"), box.alias("bbox"))
    return out.withColumn("geom", geo("make_envelope", F.array("bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit cells in rows of 50, one for each part."""
    k = F.col("p_partkey")
    col, row = k % 50, F.floor(k / 50)
    return rectangles(table(spark, sf_dir, "part"), k + 1, k, F.concat(F.lit("unit-"), k), col, row, col + 1, row + 1)


def shifted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells moved to the right by up to 3/64; every seventh is missing, every eleventh has another name, and copies of every 97th stand apart below."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    col, row, dx = k % 50, F.floor(k / 50), (F.col("p_size") % 4) / 64
    name = F.when(k % 11 == 0, F.concat(F.lit("new-"), k)).otherwise(F.concat(F.lit("unit-"), k))
    kept = rectangles(part.where(k % 7 != 0), k + 1, k, name, col + dx, row, col + 1 + dx, row + 1)
    added = rectangles(part.where(k % 97 == 0), k + 10_000_000, F.concat(F.lit("n"), k), F.concat(F.lit("added-"), k), col, -(row + 3), col + 1, -(row + 2))
    return kept.unionByName(added)


def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring columns fused into one cell, for all rows but the last, incomplete ones."""
    k = F.col("p_partkey")
    col, row = k % 50, F.floor(k / 50)
    return rectangles(table(spark, sf_dir, "part").where(k % 2 == 0), k + 1, k, F.concat(F.lit("pair-"), k), col, row, col + 2, row + 1)


def wide_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in rows of 20, one for each supplier, widened to the right by up to 2/64 so that some overlap."""
    k = F.col("s_suppkey")
    col, row = k % 20, F.floor(k / 20)
    return rectangles(table(spark, sf_dir, "supplier"), k + 1, k, F.col("s_name"), col, row, col + 1 + (k % 3) / 64, row + 1)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each event, never on a cell's border."""
    x = F.col("user_id") % 50 + (F.col("event_id") % 31 + 1) / 64
    y = F.floor(F.col("event_id") / 50) % 45 + (F.col("event_id") % 29 + 1) / 64
    return rectangles(table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_id"), F.col("event_type"), x, y, x, y).withColumn("geom", geo("make_point", F.col("bbox.xmin"), F.col("bbox.ymin")))
