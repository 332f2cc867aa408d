"""From a checked query object to a DataFrame."""
