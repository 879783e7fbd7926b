"""millrace: a Spark-native mining and analytics engine.

Every operator is a function from DataFrames and parameters to a DataFrame.
Functions that run in Python workers are pickled by value, so executors need
pyspark, pyarrow and numpy but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
