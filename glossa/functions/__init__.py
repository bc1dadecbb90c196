"""Functions: configuration, byte-string expressions and text rendering."""
