"""Operators for training-data pipelines. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
