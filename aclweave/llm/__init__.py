"""Operators for building training corpora; nothing outside this subpackage imports it.

Functions that run in Python workers travel by value, so executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["aclweave"])
