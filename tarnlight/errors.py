"""What a statement is refused with. Limits refuse; they never truncate an answer."""


class QueryError(Exception):
    """The statement cannot be read or does not hold together."""


class TypeMismatch(QueryError):
    """A value has no reading as the type that is asked for."""


class Duplicate(QueryError):
    """A unique key is held already."""


class Unmet(QueryError):
    """A `require` did not hold; nothing is written."""


class Conflict(QueryError):
    """Another writer committed first; nothing is written."""


class Gone(QueryError):
    """What is asked for has been let go of already."""
