"""Rows in an order that any values have."""


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
