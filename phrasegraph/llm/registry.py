"""Importing the query module and the pipeline fills the registry."""

from . import pipeline
from .queries import QUERIES, SQL

QUERIES["pipeline"] = pipeline.run
if pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = pipeline.ORACLE_SQL
