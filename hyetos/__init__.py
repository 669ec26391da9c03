"""Gridded and station time-series correction and verification, and training-data operators, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
__version__ = "0.3.0"
