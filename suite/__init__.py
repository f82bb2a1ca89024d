"""Queries over the driver's tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = ("report_queries", "change_queries", "history_queries", "import_queries", "content_queries", "stream_queries")


def load():
    """The registry with every query module imported."""
    for module in MODULES:
        importlib.import_module(f"suite.{module}")
    return importlib.import_module("suite.registry")
