"""All registered queries: importing this module fills the registry.

Modules are listed from the cheap to the dear, and queries that fit models of every fold come last of all, so that a slow query
takes its time from none of the others.
"""

from importlib import import_module

from tenura.plans.registry import ORACLES
from tenura.plans.registry import QUERIES as _REGISTERED

for _name in ("encoding", "report", "distribution", "evaluation", "table", "model", "check"):
    import_module(f"tenura.plans.{_name}_queries")

_LAST = ("churn_cross_validation", "ltv_cross_validation")
QUERIES = {n: q for n, q in _REGISTERED.items() if n not in _LAST} | {n: _REGISTERED[n] for n in _LAST}

__all__ = ["ORACLES", "QUERIES"]
