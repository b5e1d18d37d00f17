"""DataFrame operators for raster evaluation, map features, captions and retrieval."""
