"""Readers and writers: asset folders, run documents, manifests, model artifacts, tables."""
