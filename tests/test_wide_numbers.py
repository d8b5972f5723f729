"""Numbers beyond 64 bits."""

from __future__ import annotations

from cadenza import registry
from cadenza.functions import values as V
from pyspark.sql import functions as F


def test_human_numbers_pass_64_bits(spark, tmp_path):
    spark.createDataFrame([(303_707,), (400_003,), (200_000_003,), (4,), (5,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: r["number"] for r in registry.queries()["fn_human_number"](spark, str(tmp_path)).collect()}
    assert got[4] == "16" and got[5] == "24 925"
    for key in (303_707, 400_003, 200_000_003):  # all leave 3 when divided by 4
        tenth = key * key * 100_000_007 // 10**17
        assert got[key] == (f"{tenth // 10}.{tenth % 10}E" if tenth % 10 else f"{tenth // 10}E")


def test_human_numbers_of_every_size(spark):
    cases = [(None, None), (0, "0"), (999, "999"), (1000, "1 000"), (999_999, "999 999"), (1_000_000, "1M"), (1_099_999, "1M"), (1_150_000, "1.1M"), (12_999_999_999, "12.9B"), (10**18, "1E"), (-1_234_567, "-1 234 567")]
    rows = spark.createDataFrame(cases, "n long, wanted string")
    for kind in ("long", "decimal(38,0)"):
        assert all(r[0] == r[1] for r in rows.select("wanted", V.human_number(F.col("n").cast(kind))).collect())
