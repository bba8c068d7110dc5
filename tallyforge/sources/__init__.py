"""Readers and writers, and the mapping of tables to the roles that operators expect."""
