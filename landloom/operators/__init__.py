"""DataFrame operators: joins, aggregates, topology, alignment, workflow."""
