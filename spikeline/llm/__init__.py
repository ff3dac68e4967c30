"""Operators for preparing training corpora. Nothing outside this subpackage imports it.

Functions that run inside tasks are shipped by value, so executors need numpy,
pyarrow and (for packing) tokenizers, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
