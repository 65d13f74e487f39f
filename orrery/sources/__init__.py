"""Readers, writers and the views that shape the test tables like the catalogue."""
