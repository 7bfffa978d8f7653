"""linkspark: multi-source record linkage and corpus processing on PySpark DataFrames."""
