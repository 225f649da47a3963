"""sources of the folia engine."""
