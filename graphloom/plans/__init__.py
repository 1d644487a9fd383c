"""Registered queries; importing the package fills ``catalog.QUERIES`` and ``catalog.SQL``."""

from . import catalog, elements, steps  # noqa: F401
