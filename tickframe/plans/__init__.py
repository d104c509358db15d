"""Plan building blocks shared by the operators: filters, top-n, dedup, dimensions."""
