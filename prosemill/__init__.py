"""Prosemill: analytics over narrative text, declared as Spark DataFrame plans.

Functions that run in Python workers travel by value, so a cluster needs no
installed copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
