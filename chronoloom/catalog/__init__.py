"""Registered queries over the shared tables, and the SQL that states what each must return."""
