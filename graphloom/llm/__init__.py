"""Operators of a training-data pipeline. Nothing outside this folder, its tests and corpus_pipeline.py imports it."""

import sys

from pyspark import cloudpickle

# Python code of these operators travels with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
