"""corpuscat: text-corpus preparation, categorisation and reporting on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so that only the driver needs it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
