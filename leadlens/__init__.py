"""leadlens: early-signal analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame or a builder of Columns; actions are
run by the batch and streaming drivers in :mod:`leadlens.plans` and :mod:`leadlens.streaming`, and by the few
operators that say that they checkpoint.
"""

__version__ = "0.1.0"
