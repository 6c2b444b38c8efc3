"""Debounced change streams and incremental refresh."""
