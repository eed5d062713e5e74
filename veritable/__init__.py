"""veritable: verified table analysis as Spark DataFrame jobs.

Profile a table, clean it, join its lookups, derive measures, answer bounded
questions, compute KPIs and chart tables, and test every conclusion
(significance, confounding, attribution, grounding) before it is reported.

Every operator is a function from DataFrames to a lazy DataFrame; Catalyst plans
the work. Actions happen only where a caller asks for values.
"""

from veritable.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
