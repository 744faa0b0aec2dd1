"""Query plans over the given tables, on top of the engine."""
