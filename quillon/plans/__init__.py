"""Queries over the library's operators, and the same results as SQL."""

from __future__ import annotations

from .audit import ORACLES as _audit_sql
from .audit import QUERIES as _audit
from .corpus import ORACLES as _corpus_sql
from .corpus import QUERIES as _corpus
from .corpus import lore_release_articles as flagship
from .lifecycle import ORACLES as _lifecycle_sql
from .lifecycle import QUERIES as _lifecycle
from .serving import ORACLES as _serving_sql
from .serving import QUERIES as _serving

QUERIES = _corpus | _audit | _lifecycle | _serving
ORACLES = _corpus_sql | _audit_sql | _lifecycle_sql | _serving_sql

__all__ = ["ORACLES", "QUERIES", "flagship"]
