"""Column-level functions: no action, no shuffle."""
