"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; scratch tables go to the folder named by ``spark.checkpoint.dir``.
"""
