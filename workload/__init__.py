"""The operators wired to the test tables, each with its oracle SQL."""
