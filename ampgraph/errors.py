"""Errors raised on the driver; executors return reason rows instead."""


class AnalyticsError(ValueError):
    """Base of all."""


class InvalidCoordinate(AnalyticsError): ...


class InvalidGraphConfig(AnalyticsError): ...


class InvalidAdjacency(AnalyticsError): ...


class InvalidFilterParameter(AnalyticsError): ...


class IncompleteSignal(AnalyticsError): ...


class ZeroDegreeNode(AnalyticsError): ...


class InsufficientMeters(AnalyticsError): ...


class IncompleteMeter(AnalyticsError): ...


class NoMetersFound(AnalyticsError): ...


class DetectorError(AnalyticsError): ...


class WindowError(AnalyticsError): ...


class CalibrationError(AnalyticsError): ...


class TopologyMismatch(CalibrationError): ...


class SettingsError(AnalyticsError): ...


class PublishError(AnalyticsError): ...


class InvalidSpec(AnalyticsError): ...


class UnknownDevice(InvalidSpec): ...


class BoundsViolation(InvalidSpec): ...


class SourceError(AnalyticsError): ...


class SourceTimeout(SourceError): ...
