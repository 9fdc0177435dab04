"""Programs over event streams."""
