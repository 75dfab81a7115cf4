"""Plans shared by operators, and the registered queries."""
