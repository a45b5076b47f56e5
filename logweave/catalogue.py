"""Every query outside the training-data subpackage, with its DuckDB SQL."""

from __future__ import annotations

from .plans import families, log_queries, relational

assert families.Q is relational.QUERIES  # families adds to them

QUERIES: dict = {**log_queries.QUERIES, **relational.QUERIES}
ORACLES: dict[str, str] = {**log_queries.ORACLES, **relational.ORACLES}
