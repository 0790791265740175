"""Column functions: text, identity parsers, BLAKE3 keys."""
