"""Time-series preparation, backtesting and model comparison as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the helpers used inside pandas/Arrow tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
