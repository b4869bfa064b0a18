"""Operators for preparing training text: fingerprints, duplicates, decontamination, language, secrets, mixtures."""

import sys

from pyspark import cloudpickle

# Task functions of this package travel by value, so workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
