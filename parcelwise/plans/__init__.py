"""Registered queries and their DuckDB oracle.

The order rows that the queries run on are defined beside the tests, outside the package, and
are loaded by path: the name ``tests`` may belong to someone else's folder on ``sys.path``.
"""

from __future__ import annotations

import importlib.util
import sys
from pathlib import Path
from types import ModuleType


def order_rows(name: str) -> ModuleType:
    """The module ``tests/<name>.py`` of this repository."""
    key = f"parcelwise_{name}"
    if key not in sys.modules:
        path = Path(__file__).resolve().parents[2] / "tests" / f"{name}.py"
        spec = importlib.util.spec_from_file_location(key, path)
        module = importlib.util.module_from_spec(spec)
        sys.modules[key] = module
        spec.loader.exec_module(module)
    return sys.modules[key]
