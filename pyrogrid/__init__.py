"""Thermogram analytics as Spark DataFrame operators.

A *pixels* table (one row per pixel, keyed by frame_id, y, x) is the common
input; every operator takes and returns DataFrames or Columns.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
