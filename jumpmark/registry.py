"""Extension points: processes, intensity estimators and codecs as objects that build columns, and a registry of codecs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame


class PointProcess(Protocol):
    """What a process must offer: its bits as a column over block features (N, r, m, H, n_trans)."""

    name: str

    def bits(self) -> Column: ...


class IntensityEstimator(Protocol):
    """What an estimator must offer: (event_type, bin, intensity) of events."""

    name: str

    def fit(self, events: DataFrame, r: int) -> DataFrame: ...


class Codec(Protocol):
    """What a codec must offer: payloads of cells, and the cells of payloads."""

    name: str

    def encode(self, cells: DataFrame) -> DataFrame: ...

    def decode(self, payloads: DataFrame) -> DataFrame: ...


_CODECS: dict[str, Callable[[], Codec]] = {}


def register(name: str, build: Callable[[], Codec]) -> None:
    """Make a codec available by its name, in any case; a later one of the same name takes its place."""
    _CODECS[name.lower()] = build


def codec(name: str) -> Codec:
    if name.lower() not in _CODECS:
        raise KeyError(f"no codec {name}; there are {', '.join(available())}")
    return _CODECS[name.lower()]()


def available() -> list[str]:
    return sorted(_CODECS)


class BlockCodec:
    """Blocks of pixels by their shortest process; nothing is lost."""

    name = "blocks"

    def encode(self, cells: DataFrame) -> DataFrame:
        from jumpmark.operators import codec as c
        from jumpmark.operators import description

        return c.block_payloads(c.group_of_pictures(cells, description.LONGEST), description.block_lengths(description.pixels(cells)))

    def decode(self, payloads: DataFrame) -> DataFrame:
        from jumpmark.operators import codec as c

        return c.block_cells(payloads)


register("blocks", BlockCodec)


@dataclass
class Settings:
    """Thresholds of the classifier and axes of a benchmark, kept as a JSON file."""

    h_s: float = 0.7
    rho_high: float = 0.8
    rho_low: float = 0.15
    chi2: float = 0.05
    codecs: list[str] = field(default_factory=lambda: ["h264", "h265", "lmd"])
    qualities: list[int] = field(default_factory=lambda: [18, 23, 28])
    max_videos: int | None = None

    def with_thresholds(self, **changed: float) -> Settings:
        return Settings(**(asdict(self) | changed))

    def thresholds(self) -> tuple[float, float, float, float]:
        return self.h_s, self.rho_high, self.rho_low, self.chi2

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self)))

    @classmethod
    def load(cls, path: str) -> Settings:
        return cls(**json.loads(Path(path).read_text()))


def with_progress(spark, told: Callable[[str, int], None]):
    """A listener that tells a stream's name and the rows of each of its batches; spark.streams.removeListener() ends it."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None: ...

        def onQueryIdle(self, event) -> None: ...

        def onQueryTerminated(self, event) -> None: ...

        def onQueryProgress(self, event) -> None:
            told(event.progress.name or str(event.progress.id), event.progress.numInputRows)

    listener = Listener()
    spark.streams.addListener(listener)
    return listener
