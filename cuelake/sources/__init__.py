"""Readers and writers for cue files, catalogues, corrections and datasets."""
