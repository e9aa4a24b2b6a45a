"""Views over the relational tables, and the named queries."""
