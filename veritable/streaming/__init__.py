"""Re-running the batch checks on arriving data (no streaming operator of its own).

The analysis the library rebuilds has no streaming operator. This package only
lets the existing batch operators (claim tests, KPIs) run on every
micro-batch of a Structured Streaming source, through ``foreachBatch``.
"""

from veritable.streaming.monitor import monitor_claims  # noqa: F401
