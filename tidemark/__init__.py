"""Market-structure and signal-validation engine expressed as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
