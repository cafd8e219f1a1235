"""Options, schemas and SQL names."""
