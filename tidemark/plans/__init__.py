"""Query specifications and the query registry."""
