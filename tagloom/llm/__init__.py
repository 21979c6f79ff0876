"""Operators for preparing training text at scale: labelling, deduplication, filtering, archives, tokens."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions of this folder travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
