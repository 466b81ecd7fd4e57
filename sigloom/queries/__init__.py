"""The registered queries, by surface."""

from sigloom.queries import formats, logs, matrix, metrics, search, streams, traces  # noqa: F401
