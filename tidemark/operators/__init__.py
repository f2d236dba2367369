"""Operators on frames, and transforms across assets and sessions."""

from . import cross_section, sessions, trade  # noqa: F401
