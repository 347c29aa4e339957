"""The two kinds of failure when data are read under a schema."""


class DecodeError(Exception):
    pass


class SchemaMismatch(DecodeError):
    """The stored branches don't fit the reader's schema."""


class InvalidFormat(DecodeError):
    """A payload can't be what its encoding says."""
