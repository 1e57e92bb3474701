"""Quarry: DataFrame-in, DataFrame-out operators for paged documents and financial facts."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code: executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
