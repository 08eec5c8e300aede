"""Training-data operators: every module stands alone on top of PySpark, numpy and pyarrow."""
