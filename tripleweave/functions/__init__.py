"""Column expressions: terms, filters, prefix tables, Bloom filter words."""
