"""Errors that callers are expected to handle."""


class LinkageError(Exception):
    """Base of the expected errors."""


class ConfigError(LinkageError):
    """Bad or missing configuration."""


class ConfirmationRequired(LinkageError):
    """Something destructive was asked for without confirmation."""
