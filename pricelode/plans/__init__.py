"""Whole jobs: the library's entry points."""
