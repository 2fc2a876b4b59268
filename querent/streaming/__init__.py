"""Relations over streams: any stateless relation runs on ``readStream`` frames as it is."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from querent.operators.relation import FrameRelation
from querent.sources.database import Database
from querent.sources.model import Model


def over_stream(stream: DataFrame, model: type[Model], db: Database) -> FrameRelation:
    """A streaming DataFrame as a relation with the model's columns."""
    if not stream.isStreaming:
        raise TypeError("the frame is not a stream")
    return FrameRelation(stream.select(*model.names()), model.shape())


def start(db: Database, rel: Any, names: list[str], sink: str = "memory", **options: str) -> Any:
    """Starts the relation's stream in append mode."""
    return db.frame(rel, names).writeStream.format(sink).outputMode("append").options(**options).start()
