"""All registered queries."""

from plumbline.plans import scores, statistics, store, traces, monitoring, learning, streams  # isort: skip  # noqa: F401
from plumbline.plans.registry import ORACLE, QUERIES  # noqa: F401
