"""helpdeck: service-desk ticket analytics as Spark DataFrame operators.

Sub-packages
------------
sources    table reads, ticket-shaped views over the test tables, file I/O
functions  Column expressions (text, dates, labels) - all built-in, no UDFs
operators  filters, enrichment joins, reports, ranking, calendar,
           notifications, delivery, change application, quality checks
plans      the query catalog (name -> Spark builder, name -> DuckDB oracle SQL)
streaming  Structured Streaming versions of unread counts, failure bursts
           and latest status
"""

from helpdeck.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
