"""The same plans as micro-batches."""
