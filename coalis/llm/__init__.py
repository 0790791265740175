"""Training-data operators: survivorship, components, near-duplicates, incremental
deduplication, packing, mixing, truncation.  Nothing else in the library imports this."""
