"""Whole runs composed of operators: generate, review, upload, import."""
