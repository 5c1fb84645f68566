"""Training-data operators: duplicates, search, scoring, language, secrets, packing, encoding.

Functions of this package travel to the executors by value, so a cluster needs no installed copy.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
