"""Table profiling, cleaning, statistics, modelling and forecasting as Spark jobs.

Every operator takes a DataFrame and returns a DataFrame (or a small fitted
object); import them from the modules below.

``sources``    reading and writing tables, run log, saved pipelines
``functions``  column expressions and the numpy kernels used inside tasks
``operators``  the table operators
``plans``      cleaning step lists and the catalogue of registered queries
``streaming``  the stateful stream operator
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the executors by value, so that grouped
# pandas tasks run there without the package being installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
