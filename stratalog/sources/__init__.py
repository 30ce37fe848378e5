"""Where runs are stored and read."""
