"""Flow-topology analytics on Spark DataFrames.

Functions of this package travel to the executors by value, so a cluster needs no
installed copy of it and tasks run wherever the driver was started.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
