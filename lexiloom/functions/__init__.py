"""Column expressions: no action, no shuffle, JVM only."""
