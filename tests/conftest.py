import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from foldspark import session

    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield session.tune(s)
    s.stop()


def rows_frame(spark, matrix, **columns):
    """``(row_id, v, ...)`` from a numpy matrix."""
    data = [(i, [float(t) for t in r], *(c[i] for c in columns.values())) for i, r in enumerate(matrix)]
    types = {int: "long", float: "double", str: "string"}
    extra = "".join(f", {n} {types[type(c[0])]}" for n, c in columns.items())
    return spark.createDataFrame(data, "row_id long, v array<double>" + extra)
