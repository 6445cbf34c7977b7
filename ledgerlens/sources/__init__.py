"""Record sources, adapters of shared tables, and stored intermediate tables."""
