"""Column functions and codecs."""
