"""Operators for preparing training data.  Nothing outside this package imports it."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to Python workers whole, so that a session works without
# the package being installed on its executors.
register_pickle_by_value(sys.modules[__name__])
