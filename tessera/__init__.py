"""Spark-native operators over object-detection label data."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value, so that executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
