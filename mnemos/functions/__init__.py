"""functions of the core engine."""
