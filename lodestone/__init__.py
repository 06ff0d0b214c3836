"""lodestone: a PySpark-native engine for building, auditing and verifying language-model datasets."""

import os
import sys

from pyspark import cloudpickle

# Python workers import this package by name where their path has it (PYTHONPATH, --py-files or the
# working directory); elsewhere its functions travel with the tasks that call them.
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_PATHS = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
if _ROOT not in _PATHS and os.getcwd() != _ROOT:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
