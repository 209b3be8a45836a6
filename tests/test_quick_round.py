"""Rounding without decimals gives the very doubles that decimals give."""

import struct

import pytest
from pyspark.sql import functions as F

from vitrine.functions import scalars as S


@pytest.mark.parametrize("places", [0, 2, 4, 6, 8, 9])
def test_quick_rounding_is_rounding(spark, places):
    near = [k * 0.5 * 10.0**-places + d for k in range(-9, 10) for d in (0.0, 1e-13, -1e-13, 4e-12, -3e-7, 1e-17)]
    odd = [None, float("nan"), float("inf"), -float("inf"), -0.0, 1e-320, 1e18, -1e25, 1e300, 123456789.0125, 1073.741824]
    fixed_rows = spark.createDataFrame([(v,) for v in near + odd], "v double")
    drawn = spark.range(200_000).select(
        ((F.rand(7) - 0.5) * F.pow(F.lit(10.0), F.pmod("id", F.lit(9)))).alias("v")
    )
    rows = fixed_rows.unionAll(drawn).select("v", S.quick_rnd(F.col("v"), places).alias("q"), S.rnd(F.col("v"), places).alias("r"))
    bits = lambda x: None if x is None else struct.pack("d", x)
    assert [r for r in rows.collect() if bits(r.q) != bits(r.r)] == []
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert ("CASE WHEN" in plan) == (places <= 8)
