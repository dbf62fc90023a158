"""DataFrame-to-DataFrame operators over experiments."""
