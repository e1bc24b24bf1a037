"""See the package docstring of tallyline."""
