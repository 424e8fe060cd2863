"""Readers and writers: record dumps, BibTeX files, the published catalogue."""
