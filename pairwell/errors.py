"""Errors raised by the package."""


class PairwellError(Exception):
    """Base of every error raised on purpose."""


class ConfigError(PairwellError):
    """A column configuration or match spec is inconsistent with itself or with the data."""


class LoadError(PairwellError):
    """A table could not be read."""


class MergeError(PairwellError):
    """Two populations cannot be stacked."""


class MatchError(PairwellError):
    """Matching cannot be carried out on this cohort."""


class StoreError(PairwellError):
    """A result could not be written or read back."""


class UnsupportedCapability(PairwellError):
    """An option is known but not available."""

    def __init__(self, field, value, status="planned"):
        super().__init__(f"{field}={value!r} is not available (status: {status})")
        self.field = field
        self.value = value
        self.status = status
