"""Registered queries: each is a thin call into the engine, with independent SQL where SQL can express it."""

from . import density_queries, graph_queries, kernel_queries, model_queries, report_queries, sample_queries, testing_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
