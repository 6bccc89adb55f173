"""Business-network analytics on Spark: change feeds, keyed tables, classification,
entity resolution, graph, search and lineage as DataFrame plans."""
