"""Queries over the driver's tables, one per operator or small group, with their SQL."""
