"""What can be wrong with a query."""


class QueryError(Exception):
    """Any failure of the query language."""


class ParseError(QueryError):
    """The text isn't in the grammar; ``offset`` is where."""

    def __init__(self, message: str, offset: int) -> None:
        super().__init__(f"{message} (at offset {offset})")
        self.offset = offset


class ValidationError(QueryError):
    """The query is well-formed but not allowed or not meaningful."""


class CapabilityError(QueryError):
    """The query needs something that the engine was told not to offer."""

    def __init__(self, needed: str, offered: frozenset[str]) -> None:
        super().__init__(f"the query needs '{needed}', which is not offered; offered: {', '.join(sorted(offered))}")
        self.needed = needed


class GuardrailError(QueryError):
    """A bound was broken so badly that there is no partial result."""


class DisabledError(QueryError):
    """Structural queries are switched off."""
