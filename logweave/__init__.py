"""Log analytics and anomaly detection on Spark.

Functions of this package that run in Python workers are shipped by value, so
a job can start from any folder and executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
