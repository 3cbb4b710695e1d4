"""Where triples, query logs and catalogs come from and go to."""
