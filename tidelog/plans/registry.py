"""All registered queries over the given tables, by operator."""

from __future__ import annotations

from tidelog.plans import queries as Q
from tidelog.plans import rendered as R
from tidelog.plans.queries import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

QUERIES: dict = {f"parse_{R.plain(f)}": R.parse_query(f) for f in R.FORMATS} | Q.QUERIES
ORACLE_SQL: dict[str, str] = {f"parse_{R.plain(f)}": R.parse_oracle(f) for f in R.FORMATS} | Q.ORACLE_SQL
