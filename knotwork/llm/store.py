"""Tables that cut lineage, kept in the folder that the cluster shares."""

from knotwork.plans.lineage import drop, keep, shared_dir

__all__ = ["drop", "keep", "shared_dir"]
