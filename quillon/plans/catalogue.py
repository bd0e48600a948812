"""All queries over the library's own operators, and their SQL."""

from quillon.plans import conversations, detection, exchange, pieces, records, requests

QUERIES = detection.QUERIES | conversations.QUERIES | exchange.QUERIES | records.QUERIES | requests.QUERIES | pieces.QUERIES
SQL = detection.SQL | conversations.SQL | exchange.SQL | records.SQL | requests.SQL | pieces.SQL
