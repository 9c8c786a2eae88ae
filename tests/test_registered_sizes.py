"""Registered model queries run with the default learner sizes."""

import pytest

from trellis.plans import catalogue, workflow


@pytest.mark.parametrize("name, flow", [("ml_model_comparison", "classification"), ("ml_model_comparison_smote", "classification"),
                                        ("type_prediction_report", "type_prediction")])
def test_default_sizes(spark, monkeypatch, name, flow):
    seen = []

    class Stop(Exception):
        pass

    def spy(df, key, label, features, sizes=None, **kw):
        seen.append(sizes)
        raise Stop

    monkeypatch.setattr(workflow, flow, spy)
    with pytest.raises(Stop):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [None]
