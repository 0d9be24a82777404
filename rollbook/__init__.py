"""Spark-native checking of collected signature sheets and field-operations figures.

Every public function takes and returns DataFrames (or Columns); thresholds are
keyword parameters. Nothing here reads the clock: callers pass ``as_of``.
"""
