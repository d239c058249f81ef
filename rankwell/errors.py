"""Errors raised when a structure is built."""


class BuildError(ValueError):
    """The input does not satisfy what a structure asks of it."""


class DuplicateKey(BuildError):
    pass


class MismatchedKeysAndValues(BuildError):
    pass


class ValueTooLarge(BuildError):
    pass


class NotMonotone(BuildError):
    pass


class Unsolvable(BuildError):
    pass
