"""Intermediate tables in the folder that all executors share."""

from kvflow.plans.store import drop, shared_dir, written

__all__ = ["drop", "shared_dir", "written"]
