"""Queries by subject, registered on import."""

from . import decisions, files, identity, pages, reports  # noqa: F401
