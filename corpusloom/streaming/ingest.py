"""Incremental ingest: arriving page files become chunks of a stored collection."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from corpusloom.operators import chunking
from corpusloom.sources.tables import Collection, PlacedChunks

PAGE = "filename string, file_path string, file_type string, page_number bigint, text string, version bigint"


def make_chunks(pages: DataFrame, collection: Collection, chunks: Column | None = None) -> PlacedChunks:
    """The chunks of a page table, whose pages are cut once and stored by bucket of the collection; they are numbered as they are read."""
    return PlacedChunks(pages, chunks if chunks is not None else chunking.separator_levels(F.col("text")), collection.leaves.bucket())


def ingest_pages(pages: DataFrame, collection: Collection, chunks: Column | None = None) -> None:
    """Chunk the files of ``pages`` anew from the newest version of each that has arrived so far."""
    made = make_chunks(collection.add_pages(pages), collection, chunks)
    try:
        collection.replace_files(made)
    finally:
        made.drop()


def watch_pages(
    spark: SparkSession,
    path: str,
    collection: Collection,
    checkpoint: str,
    chunks: Callable[[], Column] | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Ingest JSON-lines page files as they arrive under ``path``; processes what is there and stops.

    A file's pages may arrive in several batches and in any order: arrived pages are kept, and each batch
    chunks its files from all of them. A batch replayed after a failure adds equal pages, which count once.
    """
    arriving = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", max_files).json(path)

    def write(batch: DataFrame, _: int) -> None:
        ingest_pages(batch, collection, chunks() if chunks else None)

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressEvents(StreamingQueryListener):
    """Progress of running queries as server-sent events, handed to ``emit``."""

    def __init__(self, emit: Callable[[str], None]):
        self.emit = emit

    def _send(self, kind: str, **data: object) -> None:
        self.emit(f"data: {json.dumps({'type': kind, **data}, ensure_ascii=False)}\n\n")

    def onQueryStarted(self, event) -> None:
        self._send("rag_step", label="started", id=str(event.id))

    def onQueryProgress(self, event) -> None:
        self._send("content", batch=event.progress.batchId, rows=event.progress.numInputRows)
        for name, counted in (event.progress.observedMetrics or {}).items():
            self._send("counters", name=name, batch=event.progress.batchId, **counted.asDict())

    def onQueryIdle(self, event) -> None:
        self._send("rag_step", label="idle", id=str(event.id))

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._send("error", content=event.exception)
        self.emit("data: [DONE]\n\n")
