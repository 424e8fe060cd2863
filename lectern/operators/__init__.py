"""Record operators: filters, joins, search, linkage, transformation, documents."""
