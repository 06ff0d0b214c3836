"""Queries over the reference operators: name -> function of (spark, sf_dir), and their DuckDB SQL."""

from lodestone.plans import builds, descriptions, filters, pieces, sequences, similarity, streams, tools  # noqa: F401  (they add their queries)
from lodestone.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
