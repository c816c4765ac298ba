"""Whole jobs: the domain analyses, and the same operators over the test tables."""
