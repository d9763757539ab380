"""Comparing the versions of a layer as they arrive on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions.geometry import register
from tessella.operators.spatial_join import with_bbox
from tessella.plans.change import Change, ChangeOptions, compare


def compare_versions(stream: DataFrame, folder: str, handle: Callable[[str, str, Change], None], options: ChangeOptions = ChangeOptions(), **trigger) -> StreamingQuery:
    """Starts a query that compares each version with the one before it and hands the result on.

    ``stream`` has (version, fid, code, name, geom); all rows of a version come in one batch,
    and versions sort by name. The newest version is kept below ``folder``, which all
    executors share, so that a restarted query goes on where it stopped; a batch that comes
    again after a failure is compared again. Other keyword arguments are the trigger's.
    """
    spark = stream.sparkSession
    register(spark)
    base = folder.rstrip("/")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        names = [r.version for r in batch.where("version is not null").select("version").distinct().orderBy("version").collect()]
        before = _newest(spark, base, batch_id)
        last = None
        for name in names:
            own = with_bbox(batch.where(F.col("version") == name).select("fid", "code", "name", "geom").where("geom is not null"))
            if before is not None:
                old = before.select("fid", "code", "name", "geom").transform(with_bbox)
                handle(before.select("version").first()[0], name, compare(old, own, options)[0])
            before = last = own.select(F.lit(name).alias("version"), "fid", "code", "name", "geom")
        if last is not None:
            last.write.mode("overwrite").parquet(f"{base}/version/batch={batch_id}")

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{base}/progress").trigger(**(trigger or {"availableNow": True})).start()


def _newest(spark, base: str, batch_id: int) -> DataFrame | None:
    """What the batches before this one left."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/version")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return None
    seen = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if "=" in s.getPath().getName()]
    seen = [n for n in seen if n < batch_id]
    return spark.read.parquet(f"{base}/version/batch={max(seen)}") if seen else None
