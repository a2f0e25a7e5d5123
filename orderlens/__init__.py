"""Order-line analytics on Spark: cleaning, KPIs, inventory, statistics, forecasts and late-delivery models."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helper functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
