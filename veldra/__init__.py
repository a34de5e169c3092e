"""Veldra: equation-discovery analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so a cluster needs no copy of it on each machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
