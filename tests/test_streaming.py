from tessella.functions.geometry import geo, register
from tessella.plans.change import cluster_summary
from tessella.streaming.versions import compare_versions


def test_versions_are_compared_in_order(spark, tmp_path):
    register(spark)
    schema = "version string, fid long, code string, name string, geom binary"

    def add(version, rows):
        df = spark.createDataFrame([(version, i, str(i), f"u{i}", list(map(float, b))) for i, b in rows], "version string, fid long, code string, name string, b array<double>")
        df.select("version", "fid", "code", "name", geo("make_envelope", "b").alias("geom")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    seen = []

    def handle(old, new, result):
        seen.append((old, new, {r.relationship_class: r.clusters for r in cluster_summary(result).collect()}))

    add("v1", [(1, [0, 0, 1, 1]), (2, [1, 0, 2, 1])])
    add("v2", [(1, [0, 0, 1, 1]), (2, [1, 0, 1.5, 1]), (3, [1.5, 0, 2, 1])])
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        compare_versions(stream, str(tmp_path / "state"), handle).awaitTermination()
        if len(seen) == 1:
            add("v3", [(1, [0, 0, 1, 1])])
    assert seen == [("v1", "v2", {"unchanged": 1, "split": 1}), ("v2", "v3", {"unchanged": 1, "removed": 2})]
