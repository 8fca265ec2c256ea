"""DataFrame operators on bars, archives, manifests, instruments, orders and portfolios."""
