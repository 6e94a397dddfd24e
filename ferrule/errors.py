"""Errors that refuse a request; all are raised before a job runs unless the data themselves are at fault."""


class Refused(ValueError):
    """Something cannot be done exactly, so it is not done."""


class Unverified(RuntimeError):
    """A comparison could not be made."""
