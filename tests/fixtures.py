"""Synthetic recordings for tests."""

from spindrift.sources.synthetic import recording, templates  # noqa: F401
