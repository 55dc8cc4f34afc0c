"""Plan-level helpers: lineage, ranks, joins by grid cell, connected components."""
