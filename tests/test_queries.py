"""Every registered query against its SQL, which another engine runs over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from duotrace.plans import registry

SF = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    put = lambda v: (v is None, "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v)
    return sorted((tuple(put(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, str(SF))
    ours = plain(df.collect(), df.columns)
    got = con.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    theirs = plain(got.fetchall(), names)
    assert len(ours) == len(theirs) > 0
    assert ours == theirs


def test_a_search_with_its_own_fit(spark):
    """A fold's candidates are scored by the model of the other fold's rows; the ceiling that the bound relies on is computed."""
    from duotrace.config import FIXTURE
    from duotrace.functions.expr import features, linear
    from duotrace.operators import far
    from duotrace.plans import search
    from pyspark.sql import functions as F

    assert set(registry.QUERIES) - set(registry.ORACLES) == {"fitted_detections"}
    d = str(SF)
    got = {(r["seg"], r["idx"]): r for r in registry.QUERIES["fitted_detections"](spark, d).collect()}
    win, clean = search._clean(spark, d)
    models = search._models(win, search._noise(clean))
    assert models[0] != models[1] and all(m[2][3] >= 0 for m in models)
    rows = far.with_scores(far.as_pairs(search.pairing.zero_lag(win)), FIXTURE)
    c = F.col
    values = features(c("sigma_h"), c("sigma_l"), c("coh"), c("centroid_h"), c("centroid_l"), c("g_h"), c("g_l"))
    seen = set()
    for r in rows.select("seg", "idx", "fold", *(linear(values, *m).alias(f"by{k}") for k, m in enumerate(models))).collect():
        if (r["seg"], r["idx"]) in got:
            assert got[r["seg"], r["idx"]]["loglr"] == pytest.approx(r["by0"] if r["fold"] == 0 else r["by1"], abs=2e-4)
            seen.add(r["fold"])
    assert seen == {0, 1}
