"""The engine's own queries: importing this module registers them all."""

from hintloom.plans import record_queries, report_queries, retrieval_queries, text_queries

__all__ = ["record_queries", "report_queries", "retrieval_queries", "text_queries"]
