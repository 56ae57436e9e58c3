"""Regular-stream analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: what a task runs travels with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
