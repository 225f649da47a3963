"""functions of the folia engine."""
