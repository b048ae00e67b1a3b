"""tijara — retail analytics on Spark DataFrames.

Layout: ``sources`` (scans, sinks, file detection), ``functions`` (column
expressions and rule tables), ``operators`` (DataFrame -> DataFrame jobs),
``plans`` (canonical tables and result tables), ``streaming`` (incremental
ingest and windowed revenue).
"""

__version__ = "0.1.0"
