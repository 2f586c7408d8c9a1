"""Spark-native analytics over ordered, multi-channel signals.

``run`` upmixes the files of a folder under ``Settings``; ``UpmixEngine`` takes samples in blocks, ``upmix`` and
``upmix_stream`` do so for tables and streams. Layouts are in ``OUTPUT_LAYOUTS`` and ``INPUT_LAYOUTS``.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_PUBLIC = {
    "Settings": "engine", "run": "engine", "inspect": "engine", "UpmixEngine": "operators.upmix", "Routing": "operators.upmix", "upmix_stream": "operators.upmix",
    "route_spectra": "operators.upmix", "Chain": "operators.mastering", "OUTPUT_LAYOUTS": "catalog", "INPUT_LAYOUTS": "catalog",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    """Public names come from their modules when they are asked for."""
    if name not in _PUBLIC:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"wavequarry.{_PUBLIC[name]}"), name)
