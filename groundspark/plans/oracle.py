"""DuckDB SQL by query name."""

from groundspark.plans.registry import SQL

__all__ = ["SQL"]
