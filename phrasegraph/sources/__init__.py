"""Readers and writers for the tables of the pipeline."""
