"""gridspark: spreadsheet-style table work on Spark DataFrames.

Every operator is a function ``op(df, ...) -> DataFrame`` built from
Spark's built-in expressions, so Catalyst plans, prunes and distributes it.
Sub-packages:

* ``sources``   - loading and saving tables (CSV, Parquet, catalog, SQL)
* ``functions`` - Column-level helpers (blank tests, casts, text, dates, scores)
* ``operators`` - DataFrame -> DataFrame operators (filter, rank, pivot, ...)
* ``plans``     - composite plans: ordered scans, saved views, SQL surface
* ``streaming`` - Structured Streaming forms of the row-local operators
"""

from gridspark.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
