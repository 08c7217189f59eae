"""Schema crosswalk engine: map, reconcile and gate tables that name the same data differently."""

__version__ = "0.1.0"
