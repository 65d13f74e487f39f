"""Queries over the catalogue, each with the SQL it must agree with where SQL can say it."""
