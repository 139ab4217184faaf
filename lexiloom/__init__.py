"""Classification of short texts with user metadata, written for Spark.

Everything is a ``DataFrame -> DataFrame`` function or a small fitted object
whose state is bounded (means, levels, vocabulary, cut points) and whose
``transform`` is row-local.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python tasks travel with the task: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
