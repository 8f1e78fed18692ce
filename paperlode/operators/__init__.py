"""DataFrame operators: filters, joins, aggregates, windows, rankings and splits."""
