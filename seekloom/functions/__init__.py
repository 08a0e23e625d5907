"""Column expressions; all native, all row-local."""
