"""Readers and writers of single documents: bytes or text to and from the document model, as plain dicts.

They run inside Arrow batches (see vellum.sources.documents); each sees one document and keeps no state."""
