"""The event operators on unbounded input."""
