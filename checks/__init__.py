"""Registered queries, the frames they read and the SQL that checks them."""
