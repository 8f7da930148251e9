"""Part of the tempolyra library."""
