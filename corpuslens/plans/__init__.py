"""Registered queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can express them."""

from . import audit, contract, packages, rules

QUERIES = audit.QUERIES | packages.QUERIES | rules.QUERIES | contract.QUERIES
SQL = audit.SQL | packages.SQL | rules.SQL | contract.SQL

__all__ = ["QUERIES", "SQL"]
