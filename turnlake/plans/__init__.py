"""Query compilation and the verbs of the engine."""
