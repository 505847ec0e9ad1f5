"""DataFrame operators: retrieval, chunking, records."""
