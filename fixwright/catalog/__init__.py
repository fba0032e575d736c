"""Every registered query with its reference SQL, over the star-schema test tables."""

from . import archive, backpages, history, markets, pricing, streams  # isort: skip
from . import audits, dailies  # isort: skip  (its SQL builds on the others')
from .registry import QUERIES, SQL, runner

__all__ = ["QUERIES", "SQL", "archive", "audits", "backpages", "dailies", "history", "markets", "pricing", "runner", "streams"]
