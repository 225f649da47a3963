"""streaming of the folia engine."""
