"""All registered queries: name -> Spark function, name -> DuckDB SQL."""

from .plans import audits, comparison, connect, decisions, intake, linking, naming, proofs, reading, refresh, relational, sheets, streams, texts  # noqa: F401  each registers its queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
