"""The coherence ceiling takes all noise; the rate curve rounds scores as its SQL does."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import plain

from duotrace.plans import registry, search

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
def test_ceiling_of_all_noise(spark):
    n = search._clean(spark, SF)[1].filter("net >= 3").count()
    assert n > 2 * search.CONFIG.noise_cap
    assert registry.QUERIES["coherence_ceiling"](spark, SF).first()["n"] == n


def test_scores_at_halves_round_as_in_sql(spark, tmp_path):
    """Prices whose scores lie at half a hundredth, or just beside it in binary."""
    orders = spark.range(2400).select((F.col("id") * 2).alias("o_orderkey"), (250.0 + F.col("id") * 250).alias("o_totalprice"))
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    df = registry.QUERIES["far_curve"](spark, str(tmp_path))
    got = con.execute(registry.ORACLES["far_curve"])
    assert plain(df.collect(), df.columns) == plain(got.fetchall(), [d[0] for d in got.description])
