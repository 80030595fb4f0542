"""Scans and sinks: delimited text, triples, previews, narrow tables, exports."""
