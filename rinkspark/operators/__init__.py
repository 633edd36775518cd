"""DataFrame -> DataFrame operators of the league domain."""
