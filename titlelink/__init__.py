"""Record linkage of free-text listings with a catalog of entities, as DataFrame operators."""
