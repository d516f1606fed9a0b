"""The errors that operators raise."""


class GridloomError(Exception):
    """Base of all errors of this library."""


class ReaderError(GridloomError):
    """A file does not have the form that its reader expects."""


class WriterError(GridloomError):
    """An object does not have the form that a file must have."""


class TypeMismatchError(GridloomError):
    """An object is not of the kind that was asked for."""


class ConversionError(GridloomError):
    """A value does not fit the type it is converted to."""


class NoConverterError(ConversionError):
    """No chain of conversions leads from one layout to another."""


class ReorderError(GridloomError):
    """An ordering cannot be computed with the given parameters."""


class FunctionNotFoundError(GridloomError):
    """No implementation is registered under a name."""


class DirectExecutionNotAvailableError(GridloomError):
    """An operator would have to convert its input, which the caller forbade."""


class FeatureError(GridloomError):
    """A feature is unknown or listed twice."""


class FeatureParamsError(FeatureError):
    """A feature has no such parameter."""


class InvalidDataMemberError(GridloomError):
    """A part of an object that it lacks, such as values of a pattern matrix."""
