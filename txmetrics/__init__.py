"""Transcription-quality analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executor-side helpers travel with the task, so a cluster needs no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
