"""Plan-building helpers shared by the operators: columns, order, storage, joins, quantiles, metrics."""
