"""Tables shaped as places, properties, permits and catalogs, and readers for their files."""
