"""Readers for the file layout, and the versioned table directories."""
