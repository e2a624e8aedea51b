"""Every operator as a query over the driver tables, with the SQL it must agree with."""

from __future__ import annotations

import importlib

MODULES = ("flagship", "cleaning", "profiling", "charts", "sql_surface", "ingest", "activity", "streams")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
