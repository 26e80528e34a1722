"""DataFrame operators: fields, tokenisers, index building, index algebra, search."""
