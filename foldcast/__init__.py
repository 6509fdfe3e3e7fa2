"""Walk-forward and single-split forecasting of many price series as Spark jobs."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel with their code, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
