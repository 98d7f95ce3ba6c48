"""shelfmark — product-search analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  Queries, rankings,
judgments, latency samples and catalog changes are tables, so one job answers
a whole query table instead of one request at a time.
"""

from shelfmark.session import get_session

__all__ = ["get_session"]
