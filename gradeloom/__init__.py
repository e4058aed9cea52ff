"""Model-evaluation analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel by value, so executors need
# pandas and numpy but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
