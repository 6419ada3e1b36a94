"""Exceptions of the library."""


class TabulonError(Exception):
    """Base of all."""


class InvalidSchema(TabulonError):
    """A declaration is wrong, or a query names a column that the entity doesn't map."""


class EntityNotFound(TabulonError):
    """An update or a required lookup matched no row."""


class ConstraintViolation(TabulonError):
    """A write would break a key, uniqueness, not-null or foreign-key rule."""


class QueryFailed(TabulonError):
    """A query can't be answered as it was put."""


class ReadOnlyViolation(TabulonError):
    """A write to an entity or table that is declared read-only."""


class MigrationError(TabulonError):
    """A schema doesn't match its history, or a delta doesn't apply."""


class SyncError(TabulonError):
    """A batch of changes is invalid; nothing of it is applied."""
