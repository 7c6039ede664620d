"""Quillspan: catalogue curation, retrieval and text-audit queries as Spark plans."""
