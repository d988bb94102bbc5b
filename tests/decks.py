"""A deck poll for the tests."""


def online():
    return [(1, "T", "A", 128.0)]
