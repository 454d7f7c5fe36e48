"""Operators of a training-data pipeline over a ``documents`` table.

Ten independent operators (one module each), the thin registered queries
(``queries``) and shared helpers (``_common``).  Nothing else in the library
imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster
# needs no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
