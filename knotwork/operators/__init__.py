"""Relational operators over triples, mentions and graphs; each takes and gives DataFrames."""
