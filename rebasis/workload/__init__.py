"""Registered queries on the given test tables, with SQL twins for checking."""

from rebasis.workload import audit_queries, corpus_queries, vector_queries  # noqa: F401
from rebasis.workload.base import ORACLES, QUERIES  # noqa: F401
