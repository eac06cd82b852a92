"""Documents that arrive as a stream of files."""
