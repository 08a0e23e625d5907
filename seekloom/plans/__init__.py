"""Plan helpers: size checks, joins, top-k, scratch tables and the end-to-end run."""
