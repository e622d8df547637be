"""A PySpark-native engine for forest-cohort data: cleaning, distributions, succession and calibration."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
