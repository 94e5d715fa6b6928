"""Set-based creator analytics on Spark: report ingest, reporting, learning,
signal and event analysis, similarity, planning, timelines and pipeline health."""

__version__ = "0.1.0"
