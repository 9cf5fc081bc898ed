"""Spark-native lead intelligence over public permit and solicitation records."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the job, so executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
