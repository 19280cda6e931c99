"""All registered queries of the engine itself."""

from __future__ import annotations

from tessera.plans import engine, relational, systems

QUERIES = relational.QUERIES | engine.QUERIES | systems.QUERIES
ORACLE = relational.ORACLE | engine.ORACLE | systems.ORACLE
