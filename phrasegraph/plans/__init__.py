"""Plan-level helpers: durable cuts of lineage, skew-safe joins, global order."""
