"""The named queries of ``__spark_entry__`` and their checking SQL."""

from __future__ import annotations

from .registry import ORACLES, QUERIES, Query
from . import evaluate, keywords, labels, neighbours, noise, review, sampling, stages  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
