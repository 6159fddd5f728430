"""Errors of the library."""


class StrandError(Exception):
    """Base of all errors."""


class FileFormatError(StrandError):
    """A file is not of the expected kind."""


class InvalidRead(StrandError):
    """A read breaks the rules of its format."""


class InvalidReadPair(InvalidRead):
    """Two reads are no pair."""


class IncompatibleSketches(StrandError):
    """Sketches differ in k-mer size or table sizes."""


class NoMatrix(StrandError):
    """There is no matrix: fewer than two samples."""
