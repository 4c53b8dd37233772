"""DataFrame operators the queries are composed of."""
