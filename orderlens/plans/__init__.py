"""The registered queries and the equivalent SQL texts."""
