"""Imports every check module so that all queries are registered."""

from checks import catalog_checks, enrich_checks, evaluate_checks, io_checks, plan_checks, pricing_checks, profiling_checks, queryset_checks, retrieval_checks, spelling_checks  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
