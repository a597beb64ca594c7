"""Agent-memory analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions for Arrow and pandas tasks travel with the job, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
