"""Ready-made queries over the star schema, and their SQL."""
