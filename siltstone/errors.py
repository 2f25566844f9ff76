"""Errors that users of the engine see."""


class SiltstoneError(Exception):
    """Wrong input, or an operation that can't be done."""


class ParseError(SiltstoneError):
    """A file that can't be read at all."""


class CacheError(SiltstoneError):
    """A snapshot that can't be used."""
