"""Transforms that return columns; importing the package registers them all."""

from . import candles, elementwise, recurrences, structure, windows  # noqa: F401
