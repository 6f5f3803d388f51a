"""Operators for preparing training text: each works on whole tables and whole texts."""

import sys

from pyspark import cloudpickle

# Functions and classes of this package travel with the jobs, so workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
