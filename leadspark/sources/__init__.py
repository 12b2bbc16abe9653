"""Readers, writers and the projection of the test tables onto the lead domain."""
