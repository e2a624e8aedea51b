"""Importing this module registers the query of every operator."""

from . import bpe, chat, decontaminate, jaccard_join, language_id, maxent, neighbours, quality, ranked_search  # noqa: F401
from . import secret_scan, sharding, url_filter, whitening  # noqa: F401
from .common import ORACLE, QUERIES  # noqa: F401
