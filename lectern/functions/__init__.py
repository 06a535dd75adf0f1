"""Column expressions: the scalar functions of the engine."""
