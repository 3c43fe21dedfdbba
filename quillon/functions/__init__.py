"""Column functions: text folding, typed extraction, redaction, formatting."""
