"""Registered queries over the driver's tables, with the SQL that checks them."""

from . import audit_queries, cohort_queries, live_queries, model_queries, record_queries, serving_queries, sponsor_queries, survival_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
