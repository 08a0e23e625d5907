"""The registered queries over the bundled tables, and their SQL counterparts."""
