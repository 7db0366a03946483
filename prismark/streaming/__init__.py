"""Live variants of the operators."""
