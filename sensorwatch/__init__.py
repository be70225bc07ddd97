"""Early-warning analytics on per-entity sensor series, expressed as Spark plans."""
