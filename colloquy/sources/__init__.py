"""Transcript files, archive copies and summary files."""
