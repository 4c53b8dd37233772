"""Operators for preparing training corpora: documents, pages and token ids.

Functions of this package that run inside tasks are sent with the plan, so executors need
only the libraries they use, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
