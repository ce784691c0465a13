"""Spark-native analytics for perimeter security logs.

Functions that run in Python workers are sent to the executors with the job (pickled by value), so the
package need not be installed there; pyarrow, pandas and numpy must be.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
