"""Operators for preparing text corpora, and their registered queries."""

import sys

from pyspark import cloudpickle

# tasks get the functions themselves, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
