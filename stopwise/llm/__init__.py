"""Operators for preparing language-model training data, and their queries."""

import sys

from pyspark import cloudpickle

# functions travel to the executors whole, whether or not these can import this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
