"""Triple sources: one interface over a frame, a set of property tables, and a store on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.operators import layouts


class Triples:
    """``sub, prop, obj`` rows in one frame."""

    def __init__(self, frame: DataFrame):
        self._frame = frame

    def frame(self) -> DataFrame:
        return self._frame

    def scan(self, prop: str) -> DataFrame:
        """``sub, obj`` of one property."""
        return layouts.vp(self._frame, prop)

    def scan_any(self, props: Iterable[str]) -> DataFrame:
        """``sub, obj`` of several properties in one scan, as a bag."""
        return self._frame.where(F.col("prop").isin(*props)).select("sub", "obj")

    def frame_of(self, props: Iterable[str]) -> DataFrame:
        """``sub, prop, obj`` of some properties."""
        return self._frame.where(F.col("prop").isin(sorted(set(props))))

    def rows(self, props: Iterable[str]) -> dict[str, int] | None:
        """Known row counts, if there is a catalog."""
        return None


class PropertyTables(Triples):
    """One frame per property; frames are made when first read, so unused ones cost nothing."""

    def __init__(self, tables: Mapping[str, Callable[[], DataFrame]]):
        self._tables = tables

    def scan(self, prop: str) -> DataFrame:
        if prop not in self._tables:
            return next(iter(self._tables.values()))().where(F.lit(False))
        return self._tables[prop]()

    def scan_any(self, props: Iterable[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.scan(p) for p in dict.fromkeys(props)])

    def frame(self) -> DataFrame:
        return self.frame_of(self._tables)

    def frame_of(self, props: Iterable[str]) -> DataFrame:
        tables = [self.scan(p).select("sub", F.lit(p).alias("prop"), "obj") for p in sorted(set(props))]
        return reduce(DataFrame.unionByName, tables)


def as_triples(source) -> Triples:
    return source if isinstance(source, Triples) else Triples(source)
