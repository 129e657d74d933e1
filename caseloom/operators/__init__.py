"""DataFrame operators: filters, joins, aggregates, windows, ordering, sets."""
