"""Operators of a training-data pipeline. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# functions of this folder travel to executors by value: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
