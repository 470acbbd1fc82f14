"""Plan building blocks, the application interface and the query catalogue."""
