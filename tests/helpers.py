def rows(df):
    """Sorted tuples of a result."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
