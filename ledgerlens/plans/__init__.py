"""End-to-end computations over the store's tables, composed of the operators."""
