"""Where rows come from and go to."""

from tessera.sources.snapshots import SnapshotTable
from tessera.sources.tables import read, register, scan, values

__all__ = ["SnapshotTable", "read", "register", "scan", "values"]
