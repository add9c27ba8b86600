"""Deterministic identifiers and names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import col, strip
from shelfspark.session import let


def uuid5(name: Column | str, namespace: uuid.UUID = uuid.NAMESPACE_OID) -> Column:
    """Name-based (SHA-1) UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(col(name), "UTF-8")))
    return let(digest, lambda h: F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-"), F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"),
        F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)))


def archive_id(title, author) -> Column:
    return uuid5(F.concat(F.lit("archive-"), col(title), F.lit("-"), col(author)), uuid.NAMESPACE_URL)


def chunk_id(doc_id, index) -> Column:
    return F.concat(col(doc_id).cast("string"), F.lit("_chunk_"), col(index).cast("string"))


def safe_name(c: Column | str, n: int = 150) -> Column:
    """File-system safe name of at most ``n`` characters."""
    return F.substring(strip(F.regexp_replace(col(c), r'[\\/:*?"<>|]', "")), 1, n)


def drive_direct_url(c: Column | str) -> Column:
    """Shared drive link -> direct download link; anything else unchanged."""
    u = col(c)
    file_id = F.regexp_extract(u, r"file/d/([^/]*)", 1)
    shared = u.contains("drive.google.com") & u.contains("file/d/")
    return F.when(shared, F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file_id)).otherwise(u)
