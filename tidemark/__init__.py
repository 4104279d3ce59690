"""tidemark: data-quality scoring and forecasting of many time series on Spark."""

import sys

from pyspark import cloudpickle

# The small functions that run in Python workers travel with each job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
