"""Detection metrics."""
