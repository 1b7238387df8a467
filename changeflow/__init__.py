"""changeflow: change-data application, multi-source merge and
reconciliation as lazy Spark DataFrame operators.

Subpackages
-----------
functions   column expressions (JSON/concat columns, record ids, normalisers)
sources     readers, writers, table profile, derived fixture inputs
operators   mapping, transforms, merges, loads, change folds, reconciliation,
            cross-source patterns, telemetry
plans       declarative node graphs and parameterised multi-statement scripts
streaming   Structured Streaming change application (foreachBatch)
"""

from changeflow.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
