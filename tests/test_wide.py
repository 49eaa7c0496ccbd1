"""Cases that only large inputs reach, made with few rows."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldspark.operators import hic
from foldspark.schemas import CONTACTS, METRICS
from foldspark.sources import logs, matrices


def test_scaling_of_a_map_wider_than_an_int_can_square(spark):
    width = 60_000
    cells = spark.createDataFrame([("exp", 0, 0, 1.0), ("exp", 3, 5, 2.0), ("exp", 10, 12, 4.0)], CONTACTS)
    got = {r["s"]: r for r in hic.scaling(cells, width).filter("s in (0, 1, 2, 59999)").collect()}
    for s, values in {0: [1.0], 1: [], 2: [2.0, 4.0], 59_999: []}.items():
        n = width - s
        mean = sum(values) / n
        assert got[s]["mean"] == pytest.approx(mean, rel=1e-12)
        assert got[s]["std"] == pytest.approx(np.sqrt(sum(v * v for v in values) / n - mean ** 2), rel=1e-9)


def test_logs_are_stored_compressed(spark, tmp_path):
    runs = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "PCA").otherwise("SVD").alias("technique"), F.lit("single").alias("method"),
        F.lit("contact").alias("metric"), F.lit("vc").alias("norm"), (F.col("id") / 2000).alias("silhouette"),
        F.col("id").cast("double").alias("ch"), (F.col("id") / 7).alias("db")).to(METRICS)
    path = str(tmp_path / "logs")
    logs.write_logs(runs, path)
    stored = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)
    text = logs.render(runs).agg(F.sum(F.length("value"))).first()[0]
    assert stored < text / 4
    held = logs.scan(spark, path).filter(F.col("entry").contains(logs.MARKER))
    assert {r["technique"]: r["count"] for r in held.groupBy("technique").count().collect()} == {"PCA": 667, "SVD": 1333}
    assert logs.parse(held).count() == 2000


def test_wide_matrix_lines_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(matrices, "HELD_CHARS", 20_000)
    sparse = pa.record_batch([pa.array(range(50), pa.int32()), pa.array([[r] if r % 7 else None for r in range(50)]),
                              pa.array([[r + 0.5] if r % 7 else None for r in range(50)])], names=["i", "j", "v"])
    made = list(matrices._lines(1000)([sparse]))
    assert max(sum(map(len, b.column("value").to_pylist())) for b in made) < 30_000
    assert [i for b in made for i in b.column("i").to_pylist()] == list(range(50))
    cells = np.array([[float(t) for t in line.split()] for b in made for line in b.column("value").to_pylist()])
    want = np.zeros((50, 1000))
    at = [r for r in range(50) if r % 7]
    want[at, at] = np.array(at) + 0.5
    assert np.array_equal(cells, want)
