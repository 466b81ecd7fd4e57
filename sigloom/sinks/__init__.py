"""Response encodings."""
