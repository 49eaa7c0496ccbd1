"""Spark-native analytics for three-dimensional chromosome structure data."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
