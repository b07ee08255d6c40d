"""A search index kept up by a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from corvane.sources.incremental import KeyedStore


def keep_index(stream: DataFrame, store: KeyedStore, make: Callable[[DataFrame], DataFrame], checkpoint: str, seen: Callable | None = None):
    """Starts a query that takes a stream of (key, version, fingerprint, deleted, …) into a store and ends when it has taken what is there.

    Each batch reads and rewrites its own keys' buckets only. A batch that runs again after a failure finds its number applied; documents that
    come late or again lose to the version that is stored, so the index is what one build of everything would be. seen is told of each refresh.
    """

    def take(batch: DataFrame, number: int) -> None:
        done = store.refresh(batch, make, number)
        if seen is not None:
            seen(done)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
