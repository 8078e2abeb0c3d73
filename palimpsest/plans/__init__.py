"""Named queries over the driver's tables, with their SQL.

The tables stand in for the data that the operators are made for: months of orders and
line items for partition files, part files of a priority for paths that change, users'
events for read records, sign-ups for a clock, documents for texts.
"""
