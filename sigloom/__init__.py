"""sigloom: log, trace and metric analytics expressed as Catalyst plans."""

__version__ = "0.1.0"
