"""Costs are summed in the table's order and rounded as their SQL does."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ferrite.functions import small
from ferrite.plans import catalogue


def test_round_scaled(spark):
    xs = [0.22582649999999999, -0.22582649999999999, 0.5474925, 1.0000005, 0.0, 1e300, 1e305, math.inf, -math.inf, math.nan, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(small.round_scaled(F.col("x"), 6)).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in xs]
    assert list(map(repr, got)) == list(map(repr, want))
    assert got[0] == 0.225827


def test_call_costs_at_ties(spark, tmp_path):
    """Sums that end in half a millionth of a dollar, over many row groups and two files."""
    (tmp_path / "lineitem.parquet").mkdir()
    lines = [((i * 37) % 400, i % 7 + 1, float(i % 50 + 1), float(i * 7919 % 90_001 + 901)) for i in range(4000)]
    lines += [(None, 1, 2.0, 10.01), (900, 3, 1.0, 5.0), (901, 1, None, 5.0)]
    for name, part in (("a", lines[:2500]), ("b", lines[2500:])):
        columns = zip(("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), (pa.int64(), pa.int32(), pa.float64(), pa.float64()), zip(*part, strict=True), strict=True)
        pq.write_table(pa.table({n: pa.array(v, k) for n, k, v in columns}), tmp_path / "lineitem.parquet" / f"{name}.parquet", row_group_size=100)
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.execute(catalogue.ORACLE["call_costs"]).fetchall()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = catalogue.QUERIES["call_costs"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
