"""Registered queries over the driver's tables, each beside the DuckDB SQL that gives the same rows."""

from . import bar_queries, closed_queries, engine_queries, profile_queries, protocol_queries, report_queries, rule_queries, series_queries, setup_queries, trade_queries

__all__ = ["bar_queries", "closed_queries", "engine_queries", "profile_queries", "protocol_queries", "report_queries", "rule_queries", "series_queries", "setup_queries", "trade_queries"]
