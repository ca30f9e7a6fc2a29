"""Errors of the library."""


class RecordingError(Exception):
    """A recording isn't there, or isn't what was asked for."""


class XmlStructureError(RecordingError):
    """A recording's XML has an unknown layout."""
