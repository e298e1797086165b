"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("foliospark.plans.nodes", "foliospark.plans.ordered", "foliospark.plans.relations", "foliospark.plans.review", "foliospark.plans.markup", "foliospark.plans.lint", "foliospark.plans.structure", "foliospark.plans.trees", "foliospark.plans.formatting", "foliospark.plans.edits")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = import_module(_name)
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
