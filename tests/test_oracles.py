"""Every registered query of the library's own plans beside its SQL, on the smallest tables."""

import importlib
import os
import pkgutil

import pytest
from oracle import same_rows

import cairn.plans as plans

SF = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"cairn.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_same_as_sql(spark, module, name):
    if name in module.ORACLES:
        same_rows(spark, module.QUERIES[name], module.ORACLES[name], SF)
    else:
        assert module.QUERIES[name](spark, SF).count() >= 0
