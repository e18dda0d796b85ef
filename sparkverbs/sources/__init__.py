"""Reading and writing: delimited files, table bundles, markup, polygons, sequences."""
