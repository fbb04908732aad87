"""DataFrame -> DataFrame operators on transcript tables."""
