"""Plan building blocks and the query catalogue."""
