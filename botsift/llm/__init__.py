"""Operators of a training-data pipeline (decontamination, dedup, mixing, ...).

Self-contained: nothing outside this subpackage imports it.  Queries and
their SQL twins are in ``queries``; the five-stage corpus pipeline is
``corpus_pipeline.py`` at the repository top.
"""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value, so that a cluster needs
# this package on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
