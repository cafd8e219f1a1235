"""Operators of a training-data pipeline over Spark DataFrames.

Every operator takes and returns DataFrames, works on whole texts, and keeps
what it materialises in the folder of ``spark.checkpoint.dir``.  Nothing else
in the package imports this subpackage.
"""
