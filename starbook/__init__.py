"""Adapter from the driver's star tables to a settlement book, for queries and tests only."""
