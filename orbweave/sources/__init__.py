"""Readers: source files, configuration, caches and baselines."""
