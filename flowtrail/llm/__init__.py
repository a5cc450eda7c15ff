"""Operators of a training-data pipeline.

Their Python functions are sent to the executors by value, so workers need no copy of
this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
