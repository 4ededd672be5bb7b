"""Column-level building blocks: each takes and returns a ``Column``."""
