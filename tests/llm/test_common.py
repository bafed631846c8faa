"""Shared helpers."""

import itertools
import random

from pyspark.sql import functions as F

from quern.llm.common import running


def test_running_values(spark):
    random.seed(1)
    arrays = [[random.randint(-9, 9) for _ in range(n)] for n in (0, 1, 2, 255, 256, 257, 1000, 70_000)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    for r in df.select("i", running(F.col("a"), lambda x, y: x + y).alias("sums"), running(F.col("a"), F.greatest).alias("tops")).collect():
        assert r.sums == list(itertools.accumulate(arrays[r.i]))
        assert r.tops == list(itertools.accumulate(arrays[r.i], max))
