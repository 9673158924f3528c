"""Queries over the driver's tables with their SQL, and the composed pipelines."""
