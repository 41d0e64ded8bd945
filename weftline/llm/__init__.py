"""Operators for large-scale training-data pipelines. Nothing else in the library imports this.

Functions of the package travel to the executors by value, so a cluster needs no copy of it on its machines.
"""

from pyspark import cloudpickle

import weftline

cloudpickle.register_pickle_by_value(weftline)
