"""tidewatch: early-warning analytics for entity-by-month panels on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here runs a job unless its docstring says so.
"""

__version__ = "0.1.0"
