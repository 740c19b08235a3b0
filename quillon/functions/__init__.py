"""Column functions: analysis of text, time windows, keys and places, arithmetic of sparse vectors."""
