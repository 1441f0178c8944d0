"""tidemark: point-in-time analytics over event logs, written for Spark.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing in the package holds table data on the driver.
"""

__version__ = "0.1.0"
