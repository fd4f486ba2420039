"""streaming of the core engine."""
