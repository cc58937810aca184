"""No streaming operators: the engine is batch only, every result is a plain DataFrame."""
