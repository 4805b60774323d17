"""Operators of a training-data pipeline; nothing outside this subpackage imports it.

Each module holds one operator with a general interface. ``queries`` registers one query per
operator and ``corpus_pipeline.py`` at the repository top chains five of them.
"""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this package with the job, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
