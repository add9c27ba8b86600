"""Named queries over the driver tables with an independent SQL form of each."""

from __future__ import annotations


def entries() -> dict:
    """name -> (callable(spark, folder), SQL or None)"""
    from shelfspark.plans.registry import chat, chunks, recorded, records, reports, search, texts
    out: dict = {}
    for module in (texts, chunks, records, recorded, reports, search, chat):
        for name, entry in module.ENTRIES.items():
            if name in out:
                raise ValueError(f"query {name} is defined twice")
            out[name] = entry
    return out
