"""Analytics on the records of a fleet of per-user SQL engines."""
