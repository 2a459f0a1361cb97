import os

import pytest
from oracle import SMALL, same

from fernwake.plans import pipelines, reference, training_data

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", [*reference.ORACLES, *pipelines.ORACLES, *training_data.ORACLES])
def test_against_sql(spark, name):
    module = next(m for m in (reference, pipelines, training_data) if name in m.ORACLES)
    same(spark, module.QUERIES[name], module.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "label", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["logreg_probe", "svm_rbf_approx", "random_forest", "gbt"])
def test_every_row_is_scored_once(spark, name):
    rows = reference.QUERIES[name](spark, SMALL).collect()
    ids = [r.vec_id for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r.id for r in rows) == sorted(ids) and all(r.score is not None for r in rows)


def test_models_run_at_their_own_settings(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(reference.models, "held_out", lambda name, rows, dim, **p: asked.update({name: p}) or rows.withColumn("score", rows.y * 1.0))
    monkeypatch.setattr(reference.models, "search", lambda name, rows, dim, folds, grid=None: asked.update(grid=grid) or (None, {"c": 1.0}, 0.5))
    for name in ("random_forest", "gbt", "grid_search"):
        reference.QUERIES[name](spark, SMALL)
    assert asked == {"random_forest": {}, "gbt": {}, "grid": None}
