"""Errors of the engine."""


class EngineError(Exception):
    pass


class DataError(EngineError):
    """The data can't be used as asked."""


class ConfigError(EngineError):
    """An option is wrong."""


class UnsupportedLearnerError(EngineError):
    pass


class NotFittedError(EngineError):
    pass
