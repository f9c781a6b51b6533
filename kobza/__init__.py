"""kobza: a PySpark-native engine for Ukrainian text processing and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors carry their own code, so that a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
