"""Spark-native analytics for question-to-SQL evaluation data.

Every operator is a function from DataFrame to DataFrame made of Spark SQL
built-ins, so Catalyst plans it.  See README.md for the map of modules.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors need not have this package installed: its functions travel with the tasks.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
