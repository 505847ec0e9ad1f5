"""All registered queries of the library's own operators."""

from __future__ import annotations

from hybridkb.plans import builders, captures, chunking, more, records, retrieval, scalars, streams


def entries() -> dict:
    """key: (query, SQL or None)."""
    return retrieval.entries() | scalars.entries() | chunking.entries() | records.entries() | more.entries() | builders.entries() | captures.entries() | streams.entries()
