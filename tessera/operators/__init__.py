"""DataFrame -> DataFrame operators keyed by ``location_id``."""
