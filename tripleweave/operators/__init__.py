"""Statistics, layouts, semi-join reductions and workload mining."""
