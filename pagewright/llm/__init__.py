"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this subpackage.  Functions shipped to the executors are pickled by
value, so executors need only the third-party libraries, not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
