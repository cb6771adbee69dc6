"""Registered queries. Importing this package fills the registry."""

from . import chains, conversations, corpus, documents, events, fixtures, governance, pages, phrases, relational  # noqa: F401
