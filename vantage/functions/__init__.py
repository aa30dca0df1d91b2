"""Column functions: text rules of documents and registries, and angles."""
