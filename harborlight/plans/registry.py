"""All registered queries and their SQL."""

from __future__ import annotations

from . import programs, scenes
from .catalogue import Q
from .dialect import duck_sql, spark_query
from .studies import S

SHARED = Q | S
QUERIES: dict = {name: spark_query(builder) for name, builder in SHARED.items()} | programs.QUERIES | scenes.QUERIES
ORACLE: dict = {name: duck_sql(builder) for name, builder in SHARED.items()} | programs.ORACLE | scenes.ORACLE
