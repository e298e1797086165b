"""Operators for preparing language-model training data.

``queries()`` and ``oracle_sql()`` gather what each module registers. Nothing
outside this subpackage imports it, except ``__spark_entry__.py``, which does
so only where the subpackage exists.
"""

from importlib import import_module

_MODULES = (
    "decontaminate", "chat", "mixing", "lm", "toxicity", "quality_model", "secrets", "quality_rules", "token_counts", "near_dup", "manifest", "search", "pii",
)


def _gather(attr):
    out = {}
    for name in _MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), attr))
    return out


def queries():
    """Every query of this subpackage by name; each takes (spark, sf_dir)."""
    return _gather("QUERIES")


def oracle_sql():
    """DuckDB SQL for those queries that SQL can express."""
    return _gather("ORACLES")
