"""Readers and writers of projects, annotations, metadata and logs."""
