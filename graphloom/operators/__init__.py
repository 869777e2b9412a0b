"""DataFrame to DataFrame operators over the property graph."""
