"""Vectors in lists against a scan, and landing that reads only the parts that keys fall into."""

import numpy as np
from pyspark.sql import functions as F

from recollect.operators import search
from recollect.operators.vectors import VectorIndex
from recollect.streaming.ingest import known_parts, land_new, read_new


def clustered(n=4000, dims=16, groups=40):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(groups, dims))
    return [(i, (centers[i % groups] + rng.normal(scale=0.15, size=dims)).tolist(), i % 3) for i in range(n)]


def test_vector_index(spark, tmp_path):
    rows = clustered()
    extra = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, rows[5][1], 1), (9004, rows[5][1], 1)]
    table = spark.createDataFrame(rows + extra, "id long, embedding array<double>, label int")
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(table)
    scan = lambda q, fine: [(r.id, round(r.similarity, 9)) for r in search.vector_scores(table.filter(fine).filter("id not in (9001, 9002)"), q).orderBy(F.desc("similarity"), "id").limit(10).collect()]
    assert index.rows().count() == 4002
    hits = 0
    for i in (5, 17, 333):
        for fine in (F.lit(True), F.col("label") == 1):
            want = scan(rows[i][1], fine)
            assert [(r.id, round(r.similarity, 9)) for r in index.top(rows[i][1], 10, fine).collect()] == want
            hits += len({x for x, _ in want} & {r.id for r in index.top(rows[i][1], 10, fine, share=0.05).collect()})
    assert hits >= 0.95 * 60
    lists = index._nearest(rows[5][1])
    plan = index._scored([x["list"] for x in lists[:2]], rows[5][1], None)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(list" in plan.replace(" ", "") or "list" in plan
    assert index.top([0.0] * 16, 3).count() == 0 and index.top(None, 3).count() == 0
    assert index.top(rows[0][1], 10, F.col("label") == 77).count() == 0
    assert len(index.top(rows[0][1], 9999).collect()) == 4002
    empty = VectorIndex(spark, f"file://{tmp_path}/e")
    empty.build(table.filter("id = 9000"))
    assert empty.top(rows[0][1], 3).count() == 0


def test_landing_reads_the_parts_of_a_batch(spark, tmp_path):
    target, files = f"{tmp_path}/target", f"{tmp_path}/in"
    spark.range(3000).withColumn("v", F.lit(1)).write.parquet(files)
    schema = spark.read.parquet(files).schema
    land_new(read_new(spark, files, schema), "id", target, f"{tmp_path}/c", parts=16)
    spark.createDataFrame([(7, 2), (5000, 2), (5000, 3)], "id long, v int").write.mode("append").parquet(files)
    land_new(read_new(spark, files, schema), "id", target, f"{tmp_path}/c", parts=16)
    got = spark.read.schema(schema).parquet(target)
    assert got.count() == 3001 and got.filter("id = 7").first().v == 1
    known = spark.read.parquet(target)
    few = known_parts(known, [(3, -5, 5)])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part" in plan or "_part" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(_hash" in plan
