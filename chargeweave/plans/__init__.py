"""Feature tables, request scoring and model jobs composed from the operators."""
