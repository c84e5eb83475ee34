"""Every query with SQL equals DuckDB's result on the smallest tables; the others run."""

import duckdb
import numpy as np
import pytest

from probspark.operators import image_flows, tensors
from probspark.queries import ORACLES, QUERIES
from probspark.sources.matrices import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def assert_equal(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    c = sorted(got.columns)
    got, want = (x[c].sort_values(c).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for x in c:
        if got[x].dtype.kind == "f":
            assert np.allclose(got[x], want[x].astype(float), atol=1e-6, rtol=1e-9, equal_nan=True), x
        else:
            assert ((got[x] == want[x]) | (got[x].isna() & want[x].isna())).all(), x


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, con, name):
    assert_equal(QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df())


#: Run by the tests below.
HELD = {"dgcspn_score", "realnvp1d_score", "maf_score", "realnvp2d_score", "ratspn_mpe", "ratspn_sample", "realnvp2d_multiscale_score", "realnvp2d_dense_score", "realnvp1d_batchnorm_score", "dgcspn_sparse_score"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - HELD))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


SCORED = {
    "dgcspn_score": lambda: tensors.DgcSpn(1, 8, 8),
    "realnvp1d_score": lambda: tensors.realnvp(64, 2, (16,)),
    "maf_score": lambda: tensors.maf(64, 2, (16,)),
    "realnvp2d_score": lambda: tensors.realnvp_images(1, 8, 8, 4),
    "realnvp2d_multiscale_score": lambda: image_flows.realnvp2d(1, 8, 8, blocks=1, filters=4),
    "realnvp2d_dense_score": lambda: image_flows.realnvp2d(1, 8, 8, network="densenet", blocks=1, filters=2),
    "realnvp1d_batchnorm_score": lambda: tensors.realnvp(64, 2, (16,), batch_norm=True),
    "dgcspn_sparse_score": lambda: tensors.DgcSpn(1, 8, 8, pooling=2, depthwise=[True, False], products=32),
}


@pytest.mark.parametrize("name", list(SCORED))
def test_training_helps(spark, sf, name):
    rows = load(spark, sf, "embeddings").select("vec_id", "embedding")
    before = tensors.score(rows, SCORED[name](), ["embedding"]).toPandas()["ll"]
    after = QUERIES[name](spark, sf).toPandas()["ll"]
    assert len(after) == len(before) and np.isfinite(after).all() and after.mean() > before.mean()


@pytest.mark.parametrize("name,hidden", [("ratspn_mpe", "e1"), ("ratspn_sample", "e0")])
def test_completed_from_all_cells(spark, sf, name, hidden):
    got = QUERIES[name](spark, sf).orderBy("vec_id").toPandas()
    x = np.stack(load(spark, sf, "embeddings").orderBy("vec_id").toPandas()["embedding"])
    assert len(got) == len(x) and np.isfinite(got[hidden]).all()
    others = [c for c in got.columns if c.startswith("e") and c != hidden]
    assert len(others) == 63 and np.allclose(got[others], x[:, [int(c[1:]) for c in others]], atol=1e-6)
