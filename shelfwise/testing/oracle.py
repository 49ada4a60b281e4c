"""Assemble the oracle SQL for every registered query.

Each statement is self-contained: binding CTEs, mart CTEs, then the query as
a derived table whose columns are cast to the output convention recorded in
``oracle_schemas.SCHEMAS`` (BIGINT / DOUBLE / VARCHAR / DATE / BOOLEAN /
TIMESTAMP).
"""

from __future__ import annotations

from shelfwise.testing.oracle_binding import BINDING_CTES
from shelfwise.testing.oracle_marts import MART_CTES
from shelfwise.testing.oracle_queries import Q
from shelfwise.testing.oracle_views import V

try:
    from shelfwise.testing.oracle_schemas import SCHEMAS
except ImportError:  # pragma: no cover - generated file missing
    SCHEMAS = {}


def raw_queries() -> dict[str, str]:
    out = dict(V)
    out.update(Q)
    from shelfwise.testing.oracle_integrity import C_QUERIES
    from shelfwise.testing.oracle_kpis import K
    from shelfwise.testing.oracle_viewquery import VQ
    out.update(K)
    out.update(VQ)
    out.update(C_QUERIES)
    return out


def wrap(name: str, body: str) -> str:
    schema = SCHEMAS.get(name)
    if schema:
        select = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in schema)
    else:
        select = "*"
    return f"WITH {BINDING_CTES},\n{MART_CTES}\nSELECT {select} FROM ({body}) AS q"


def oracle_sql_map() -> dict[str, str]:
    return {name: wrap(name, body) for name, body in raw_queries().items()}
