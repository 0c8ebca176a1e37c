"""Unit vectors: the length is made once for each vector."""

import random

from pyspark.sql import functions as F

from cairnlake.functions.vectors import norm, unit


def test_a_length_is_made_once_for_each_vector(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(20)] + [(20, [0.0, 0.0]), (21, []), (22, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    n = norm(F.col("v"))
    plain = df.select("id", F.when(n > 0, F.transform("v", lambda x: x / n)).otherwise(F.col("v")).alias("u"))
    made = df.select("id", unit(F.col("v")).alias("u"))
    assert made.orderBy("id").collect() == plain.orderBy("id").collect()
    # the length is no part of what is done with each number
    assert made._jdf.queryExecution().analyzed().toString().split("/", 1)[1].lower().count("aggregate(") == 0
