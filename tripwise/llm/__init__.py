"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors get these functions with the task, wherever the package is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
