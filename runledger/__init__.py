"""runledger: PySpark-native analytics for batch-workflow run records."""
import sys as _sys

# Functions handed to Spark's Python workers (mapInPandas / applyInPandasWithState bodies)
# are shipped by value, so executors need neither this package installed nor the
# driver's working directory on their path.
from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
