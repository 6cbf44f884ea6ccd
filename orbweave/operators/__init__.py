"""Generic DataFrame operators: joins, suppression, graph, reports."""
