"""Code-fact analytics on PySpark: sources, operators, functions, plans and streaming."""

import sys

from pyspark.cloudpickle import cloudpickle

# functions go to the executors by value, so that these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
