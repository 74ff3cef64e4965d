"""Every registered query of the library with the DuckDB SQL that it is held against."""

from __future__ import annotations

from artifactgate.plans import approve, archives, facts, findings, formats, helpers, observe  # noqa: F401
from artifactgate.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
