"""Readers and writers: delivery listings, project files, nested documents, versions."""
