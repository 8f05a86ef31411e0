"""claimlens: claim analytics as DataFrame and Column transforms.

The public names below are imported when they are first asked for, so that
Python workers load no more than they run.  ``ship`` makes the package
importable on workers that have no copy of it.
"""

from __future__ import annotations

import importlib

_PUBLIC = {
    "functions.lexicon": ("BANGLA", "Lexicon"),
    "functions.salience": ("BANGLA_REWRITES", "Rewrites"),
    "operators": ("adapters", "claims", "dataset", "dedup", "edits", "filters", "propositions", "ranks", "reports", "verify"),
    "plans": ("config", "pipeline", "registry"),
    "sources": ("readers", "sinks", "storage"),
    "streaming": ("incremental",),
}
__all__ = ["ship", *(name for names in _PUBLIC.values() for name in names)]


def __getattr__(name: str):
    for place, names in _PUBLIC.items():
        if name in names:
            module = importlib.import_module(f".{place}", __name__)
            return getattr(module, name) if hasattr(module, name) else importlib.import_module(f".{place}.{name}", __name__)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def ship(spark) -> None:
    """Send this package to the executors, for clusters where it isn't installed."""
    import os
    import tempfile
    import zipfile

    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="claimlens-"), "claimlens.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("claimlens", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
