"""File formats: vector files, slab stores, SQLite stores, manifests and catalogs."""
