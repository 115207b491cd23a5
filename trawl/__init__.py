"""trawl: grep-style text search over DataFrames, planned by Catalyst."""
