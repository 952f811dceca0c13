"""Column functions: text clean-up, names and formats, units, JSON pointers."""
