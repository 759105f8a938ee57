"""All registered queries of the vocabulary engine and their SQL."""

from __future__ import annotations

from lexispark.plans import dictionary, vocabulary

QUERIES = vocabulary.QUERIES | dictionary.QUERIES
ORACLE_SQL = vocabulary.ORACLE | dictionary.ORACLE
