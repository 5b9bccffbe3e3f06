"""Operators for preparing training data.  Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with the tasks, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
