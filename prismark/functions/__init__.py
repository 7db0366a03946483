"""Column expressions on unrolled vectors; they stay inside whole-stage code generation."""
