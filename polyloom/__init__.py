"""A multi-model analytics engine on PySpark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their tasks, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
