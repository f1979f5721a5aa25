"""Panel operators: each takes a long panel and returns it with new values.

Statistics of an asset are windows over (factor, asset), those of a
cross-section windows over (factor, date); consecutive operators on one key share
an exchange.
"""
