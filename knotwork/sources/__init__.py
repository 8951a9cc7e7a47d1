"""Readers of triple files, page documents, CSV tables, id lists and claim documents, and the sinks that match them."""
