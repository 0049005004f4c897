import pytest
from pyspark.sql import functions as F

from larder.operators import models, trees
from tests.test_models import features, saved  # noqa: F401


@pytest.fixture
def fitted(spark, features, tmp_path):  # noqa: F811
    """Per model: the saved pipeline, its nodes, its inputs and what `transform` says."""
    made = {}
    for name, train, inputs in (("clv", models.train_clv, models.CLV_FEATURES), ("churn", models.train_churn, models.CHURN_FEATURES)):
        path = tmp_path / name
        path.mkdir()
        model = saved(train(features), path)
        nodes = trees.node_table(spark, str(path / "model")).cache()
        made[name] = model, nodes, inputs
    return made


def test_walk_agrees_with_the_model(features, fitted):  # noqa: F811
    for name, (model, nodes, inputs) in fitted.items():
        got = {r[0]: r[1] for r in trees.walked(features, ["HSHD_NUM"], inputs, nodes).collect()}
        if name == "clv":
            said = {r["HSHD_NUM"]: r["clv_score"] for r in models.clv_scores(features, model).collect()}
        else:
            said = {r["HSHD_NUM"]: r["churn_prob"] for r in models.churn_scores(features, model).collect()}
        assert len(said) == 400 and got.keys() == said.keys()
        assert len(set(said.values())) > 1
        assert all(got[k] == pytest.approx(said[k], rel=1e-9, abs=1e-12) for k in said)


def test_importances_agree_with_the_model(fitted):
    for name, (model, nodes, inputs) in fitted.items():
        got = dict(map(tuple, trees.importances_of(nodes, inputs, per_tree=name == "churn").collect()))
        said = model.stages[-1].featureImportances.toArray()
        assert [got[c] for c in inputs] == pytest.approx(list(said), rel=1e-9, abs=1e-12)


def test_every_node_is_reached_once(fitted):
    for _, nodes, _ in fitted.values():
        children = nodes.filter("feature IS NOT NULL").select("tree", F.explode(F.array("left", "right")).alias("node"))
        assert children.count() == children.distinct().count() == nodes.filter("node > 0").count()


def test_rows_without_a_value_have_no_score(features, fitted):  # noqa: F811
    _, nodes, inputs = fitted["clv"]
    rows = features.limit(3).withColumns({c: F.lit(None).cast("double") for c in inputs})
    assert [r[1] for r in trees.walked(rows, ["HSHD_NUM"], inputs, nodes).collect()] == [None] * 3
    assert trees.walked(features.limit(0), ["HSHD_NUM"], inputs, nodes).count() == 0
