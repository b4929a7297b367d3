"""graphloom: code-graph analytics and corpus processing on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
