"""Spark-native analytics over the text artefacts of binary triage."""

import sys

from pyspark import cloudpickle

# Python workers need not have this package on their path: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
