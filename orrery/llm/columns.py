"""Names for columns an operator adds to a caller's rows for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(frame: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``frame`` has, whatever the case of its letters."""
    taken = {name.lower() for name in frame.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        names.append(stem)
    return names
