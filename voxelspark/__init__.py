"""voxelspark: a Spark-native engine for labelled 3-D volumes and training-data pipelines."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
