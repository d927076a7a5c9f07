"""Sources: the table registry, file scans and the seeded demo schema."""
