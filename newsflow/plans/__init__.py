"""Named queries over the given tables, each with its SQL equivalent where SQL can say it."""

from . import queries_flow, queries_news, queries_stream, queries_text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
