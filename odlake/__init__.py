"""odlake: open-data portals as queryable lake tables, on Spark."""
