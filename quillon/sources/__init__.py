"""What is read and written: posts, web archives, books, lists of keys; rolling text, sorted and split files."""
