"""Configuration, the clip pipeline and the query catalogue."""
