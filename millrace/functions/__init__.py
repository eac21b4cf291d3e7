"""Column functions: hashes, masking, text."""
