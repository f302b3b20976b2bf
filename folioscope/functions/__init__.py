"""Column expressions and driver-side parsers."""
