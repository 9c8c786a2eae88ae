"""Scale rules as tests: no cartesian products or nested-loop joins in any
catalogue plan, and Python stages only where they are intended."""

import os

import pytest

from tests.plan_shapes import shape
from trellis.plans import catalogue

SF = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"residual_kde"}   # numpy partial sums in mapInPandas

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_plan_shape(spark, name):
    s = shape(catalogue.QUERIES[name](spark, SF))
    assert s["nested_or_cartesian"] == 0, s
    if name not in PYTHON_ALLOWED and not name.startswith("smote"):
        assert s["python"] == 0, s
