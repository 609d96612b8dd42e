"""Spark-native data quality, entity resolution and case decisions."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
