"""The queries of this subpackage, and their SQL, by name."""

from __future__ import annotations

from . import clustering, fingerprint, media, mixing, near, packing, periods, quality, search, sharding, substring, suffixes, warc

MODULES = (quality, suffixes, near, fingerprint, mixing, media, sharding, substring, warc, packing, clustering, periods, search)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
