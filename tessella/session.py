"""What the engine keeps in a session: the shared checkpoint folder, row numbers, table readers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package on to the executors, whose workers may not have it on their path; once for each context."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="tessella-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    own = os.path.join(folder, n)
                    z.write(own, os.path.relpath(own, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def computation_failed(e: Exception) -> bool:
    """Whether an error comes from what a row holds (a geometry library's, an expression's), not from a lost executor or a bug of a plan.

    A second way of computing is tried for the former alone.
    """
    text = str(e)
    return not isinstance(e, AnalysisException) and any(x in text for x in ("TopologyException", "locationtech", "FAILED_EXECUTE_UDF", "ArithmeticException"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, whatever it holds: dots, blanks, backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def _shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder: the session's ``spark.checkpoint.dir``; only where that is unset, as in tests on one machine, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessella-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    ship(df.sparkSession)
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the shared folder, for files that are written and read again."""
    return f"{_shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def numbered(df: DataFrame, name: str, *order, start: int = 1) -> DataFrame:
    """Adds consecutive numbers in the order given, or in the order of the rows' partitions.

    Unlike a window without keys this sorts by range over all tasks; only one count for each
    partition is gathered.
    """
    rows = cut((df.orderBy(*order) if order else df).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = start, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    spark = df.sparkSession
    at = F.broadcast(spark.createDataFrame(offsets or [(-1, 0)], "_part long, _offset long"))
    out = rows.withColumn("_part", part).join(at, "_part", "left")
    return out.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_offset", "_at")
