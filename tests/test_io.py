import struct

import numpy as np
from pyspark.sql import functions as F

from neighborfield.sources import readers, sinks
from neighborfield.streaming import progress


def test_text_points(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("% made up\n%\n3 2\n1 2\n3 4\n5 6\n")
    assert [r.x for r in readers.points_text(spark, str(path)).orderBy("i").collect()] == [[1, 2], [3, 4], [5, 6]]
    assert readers.points_text(spark, str(path), limit=2).count() == 2
    path.write_text("3 2\n1 2 3\n4 5\n6\n")  # values wrapped anyhow
    assert [r.x for r in readers.points_text(spark, str(path)).orderBy("i").collect()] == [[1, 2], [3, 4], [5, 6]]
    path.write_text("1,2\n3,4\n")
    assert [r.x for r in readers.points_plain(spark, str(path)).orderBy("i").collect()] == [[1, 2], [3, 4]]


def test_graph_round_trip(spark, tmp_path):
    path = tmp_path / "g.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n3 3 2\n1 2 0.5\n3 1 2\n")
    edges = readers.matrix_market(spark, str(path))
    assert {tuple(r) for r in edges.collect()} == {(0, 1, 0.5), (2, 0, 2.0)}
    assert readers.matrix_market_shape(spark, str(path)) == (3, 3, 2)
    sinks.graph_text(edges, 3, str(tmp_path / "out"))
    assert {tuple(r) for r in readers.matrix_market(spark, str(tmp_path / "out")).collect()} == {(0, 1, 0.5), (2, 0, 2.0)}
    assert "nnz = 2" in sinks.describe(edges)
    assert {tuple(r) for r in readers.triples(spark, [(0, 1, 1.0), (0, 1, 2.0)], symmetric=True).collect()} == {(0, 1, 3.0), (1, 0, 3.0)}


def test_binary_files(spark, tmp_path):
    x = np.arange(6.0).reshape(3, 2)
    path = tmp_path / "data.dat"
    path.write_bytes(struct.pack("<iiddii", 3, 2, 0.5, 30.0, 2, 1000) + x.tobytes() + struct.pack("<i", 7))
    params, points = readers.binary_points(spark, str(path))
    assert params["seed"] == 7 and params["perplexity"] == 30 and [r.x for r in points.orderBy("i").collect()] == x.tolist()
    y = spark.createDataFrame([(i, float(i), float(-i)) for i in range(4)], "i long, y0 double, y1 double")
    (tmp_path / "result.dat").write_bytes(sinks.result_binary(y))
    assert [r.y for r in readers.binary_result(spark, str(tmp_path / "result.dat")).orderBy("i").collect()] == [[i, -i] for i in range(4)]
    raw = b"".join(bytes(r.content) for r in sinks.layout_binary(y).orderBy("first").collect())
    assert np.frombuffer(raw).reshape(-1, 2)[:, 0].tolist() == [0, 1, 2, 3]
    sinks.layout_text(y, str(tmp_path / "y"))
    assert readers.layout_text(spark, str(tmp_path / "y")).count() == 4


def test_snapshots_stream(spark, tmp_path):
    y = spark.range(5).select(F.col("id").alias("i"), F.col("id").cast("double").alias("y0"), F.lit(0.0).alias("y1"))
    for step in (0, 50):
        sinks.snapshot(y.withColumn("y0", F.col("y0") * (step + 1)), step, str(tmp_path / "s"))
    q = progress.spread(progress.snapshots(spark, str(tmp_path / "s"), 2)).writeStream.outputMode("complete").format("memory").queryName("spread").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.iter, r.n, r.width) for r in spark.sql("SELECT * FROM spread").collect()} == {(0, 5, 4.0), (50, 5, 204.0)}
    times = spark.createDataFrame([(0, "attract", 2.0), (1, "attract", 3.0)], "iter int, stage string, ms double")
    assert tuple(sinks.stage_times(times).first()) == ("attract", 5.0, 2)
