"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the executors by value: they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
