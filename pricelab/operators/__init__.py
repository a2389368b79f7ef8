"""DataFrame operators (windows, joins, aggregates, corpus, models)."""
