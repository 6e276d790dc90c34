"""Column functions: guards, interpolation, labels and time."""
