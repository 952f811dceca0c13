"""Logical plans over document structs, as column expressions."""
