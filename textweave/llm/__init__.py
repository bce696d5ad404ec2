"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from textweave.llm import queries  # noqa: F401
from textweave.llm.common import ORACLES, QUERIES  # noqa: F401
