"""Location-stamped incident analytics on PySpark DataFrames."""
