"""Registered queries: `registry` has them all once this package is imported."""

from . import registry, rules, streams  # noqa: F401
