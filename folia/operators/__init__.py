"""operators of the folia engine."""
