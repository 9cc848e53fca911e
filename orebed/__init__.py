"""A PySpark-native engine that turns large document collections into structured, traceable data."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry the library's code, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
