"""quarryline: declarative matching and record-linkage analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so that these need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
