"""Drive a simulation from a stream: each micro-batch becomes edges or agents, then one step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class StreamDriver:
    """foreachBatch target: ``on_batch(sim, rows)`` gives the next simulation; a batch that comes again is skipped.

    With ``store`` a snapshot with the batch's number is written after each batch, so that a driver that starts
    again with the same store and checkpoint goes on from the last finished batch.
    """

    def __init__(self, sim, on_batch: Callable[[object, DataFrame], object], store: str | None = None):
        self.sim, self.on_batch, self.last = sim, on_batch, -1
        if store is None:
            return
        from ..sources.snapshots import list_snapshots

        done = [int(c[6:]) for _, c in list_snapshots(sim.spark, store) or [] if c.startswith("batch ")]
        if done:
            self.last = max(done)
            sim.initialized = True
            sim.read_snapshot(store, comment=f"batch {self.last}", writeable=True)
        else:
            sim.create_store(store)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if batch > self.last:
            store = self.sim.store
            self.sim, self.last = self.on_batch(self.sim, rows), batch
            if store is not None:
                self.sim.write_snapshot(f"batch {batch}")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True):
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
