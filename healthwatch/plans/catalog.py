"""Imports every query module so the registry is complete."""

from healthwatch.plans import q_detect, q_metrics, q_repair, q_sources, q_stream, q_triage  # noqa: F401
from healthwatch.plans.registry import ORACLE, QUERIES  # noqa: F401
