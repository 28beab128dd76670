"""Registered queries: importing this package fills the registry."""

from . import answer_queries, image_queries, latex_queries, metric_queries, record_queries, registry, report_queries, sample_queries, table_queries, text_queries, vision_queries

__all__ = ["answer_queries", "image_queries", "latex_queries", "metric_queries", "record_queries", "registry", "report_queries", "sample_queries", "table_queries", "text_queries", "vision_queries"]
