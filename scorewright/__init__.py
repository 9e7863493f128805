"""Spark jobs for recurring multiplayer scoring events.

Two logical tables go in: a dimension of registered users and hourly, signed
score facts.  Everything is DataFrame in, DataFrame out; the attribute column
of the users and its levels are always parameters.
"""
