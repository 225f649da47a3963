"""plans of the folia engine."""
