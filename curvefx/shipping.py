"""Functions for the workers travel by value, so that workers need no copy of the package."""

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
