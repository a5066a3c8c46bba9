"""Registered queries by area, each with SQL that gives the same rows."""
