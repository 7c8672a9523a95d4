"""Registered queries over the shared test tables, each with its SQL twin where SQL can say it."""
