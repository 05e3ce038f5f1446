"""Every query the package registers, by section."""

from colloquy.suite import curating, entities, retrieval, scans, scoring, store, streams  # noqa: F401
from colloquy.suite.registry import ORACLES, QUERIES

FLAGSHIP = "recall"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
