"""Imports every query module so that the registry is filled."""

from mailglass.plans import (  # noqa: F401
    queries_content,
    queries_corpus,
    queries_io,
    queries_mail,
    queries_models,
    queries_monitor,
    queries_senders,
    queries_similarity,
    queries_streaming,
    queries_urls,
    queries_verdict,
)
from mailglass.plans import registry

QUERIES = registry.QUERIES
ORACLES = {name: sql() if callable(sql) else sql for name, sql in registry.ORACLES.items()}
