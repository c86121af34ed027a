"""The registered query catalogue: one entry per implemented operator.

Every query reads the driver tables (the claims view over orders/customer or
the lineitem view) through the library's own operators; the SQL twins are
independent DuckDB statements over the same tables.
"""

from __future__ import annotations

from tessera.plans import q_basic, q_encode, q_eval, q_models, q_numeric, q_profile, q_stream  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES

FLAGSHIP = "v1_logloss_by_fold"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
