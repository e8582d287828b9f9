"""DataFrame operators of the registry."""
