"""duoclass: Spark-native operators for building and evaluating binary classifiers
on large labelled tables.

Every public function takes and returns DataFrames; per-example work runs on
executors, and only model-sized results (parameters, moments, metric scalars)
ever reach the driver.
"""

__version__ = "0.1.0"
