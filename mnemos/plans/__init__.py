"""The registered queries of the core engine and their DuckDB counterparts."""

from mnemos.plans import memory, reflect

QUERIES: dict = memory.QUERIES | reflect.QUERIES
ORACLES: dict = memory.ORACLES | reflect.ORACLES
