"""plumbline: PySpark-native analytics over Python source trees, with data pipeline operators beside it."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_API = ("AnalysisError", "analyze", "analyze_sources", "analyze_code", "analyze_architecture", "analyze_structure", "DETECTORS")


def __getattr__(name: str):
    """The engine's entry points, imported when they are first used."""
    if name in _API:
        from plumbline.plans import engine

        return getattr(engine, name)
    raise AttributeError(name)
