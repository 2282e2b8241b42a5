"""Part of the ledgerline library."""
