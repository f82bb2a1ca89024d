"""Content-integrity analytics on Spark: inventory, diff, validate, log, report."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
