"""Column builders: pure expressions, no shuffles."""
