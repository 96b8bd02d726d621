"""DataFrame-level operators: structure, products (four layouts), power iteration."""
