"""Spark-first analytics over token-level rollout records: contract checks, lineage, audits and corpus operators."""

__version__ = "0.1.0"
