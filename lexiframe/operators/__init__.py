"""DataFrame-to-DataFrame operators of the core."""
