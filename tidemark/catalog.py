"""All queries of the library outside of training data, and SQL that gives the same rows."""

from __future__ import annotations

from .functions import scalar
from .operators import graphs, relational, summaries
from .plans import tpch
from .sources import files
from .streaming import events

MODULES = (tpch, relational, summaries, scalar, files, events, graphs)


def queries() -> dict:
    return {n: q for m in MODULES for n, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for m in MODULES for n, q in m.oracle_sql().items()}
