"""Readers and writers for the linkage tables."""
