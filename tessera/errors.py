"""Errors that commands raise."""


class CommandError(ValueError):
    """A request that the data model refuses; its text is the reply's."""


class WrongType(CommandError):
    def __init__(self) -> None:
        super().__init__("WRONGTYPE Operation against a key holding the wrong kind of value")
