"""Manufacturing-quality analytics over Spark tables and streams.

Every public operator takes a DataFrame plus the columns that name its groups
(stream, study, plan, ...) and returns lazily evaluated DataFrames covering all
groups at once.
"""

__version__ = "0.1.0"
