"""Pieces of plans that operators share: schemas, lineage cuts, and triple views of relational tables."""
