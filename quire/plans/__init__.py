"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

MODULES = ["issue_queries", "pass_queries", "scalar_queries", "structure_queries", "content_queries",
           "table_queries", "file_queries", "stream_queries"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
