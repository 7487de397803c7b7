"""Whole runs: the papers view, progress, and the pipeline."""
