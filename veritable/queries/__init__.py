"""Registered driver queries: one per operator, each with its DuckDB oracle.

Every query reads the driver tables under ``sf_dir`` (or data Spark derives
from them) and runs over whole tables. Importing this package fills the
registry.
"""

from veritable.queries.registry import QUERIES, ORACLE, register  # noqa: F401
from veritable.queries import (  # noqa: F401
    plan, profile, cleaning, joins, features, kpis, charts, verify, runs_claims, ledger_text, sources,
)
