"""Importing the query modules fills the registry."""

from .base import QUERIES, SQL  # noqa: F401
from . import duplicates, evaluation, folds, graphs, phrases, relational, sampling, sources, streams, text, topics, vectors  # noqa: F401
