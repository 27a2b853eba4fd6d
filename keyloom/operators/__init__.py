"""DataFrame operators over the long tables described in ``keyloom.schemas``."""
