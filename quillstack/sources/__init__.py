"""Readers, and views of the test tables in the engine's schemas."""
