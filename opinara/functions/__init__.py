"""Part of the opinion analytics engine."""
