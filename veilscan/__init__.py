"""Sensitive-data discovery and risk scoring expressed as Spark DataFrame jobs."""

from veilscan.config import Settings

__all__ = ["Settings"]
