"""Several feeds merged as their pages arrive: one row of each living feed per turn.

The state of a listener is whose turn it is, how many rows were read, how far each feed has come and where it ends,
rows that came before their turn (in blocks of ``BLOCK`` positions of a feed, since each call of the state costs a round trip), and
the keys already shown.  A row is read only when all feeds before it in
its turn have been read or have ended, so pages that arrive in any number of batches get the indexes of one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

MERGED = "listener long, index long, feed string, mbid string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Positions of a feed that wait as one entry of the state, and rows that are returned at once.
BLOCK, ROWS = 4096, 50_000


class Merge(StatefulProcessor):
    """Rows (listener, feed, position, mbid, heard) to (listener, index, feed, mbid).

    A row without mbid says that its feed ends at its position.  Rows that were read already, by a page that was sent
    again, change nothing.  ``unlistened`` leaves out rows that were heard; they have an index, but do not count as shown.
    """

    def __init__(self, feeds: list[str], unlistened: bool):
        self.feeds, self.unlistened = feeds, unlistened

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "turn int, read long, next array<long>, ends array<long>")
        self.waiting = handle.getMapState("waiting", "feed int, block long", "position array<long>, mbid array<string>, heard array<boolean>")
        self.shown = handle.getMapState("shown", "mbid string", "index long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pandas as pd

        count = len(self.feeds)
        turn, read, next_, ends = self.at.get() if self.at.exists() else (0, 0, [0] * count, [-1] * count)
        next_, ends = list(next_), list(ends)
        blocks: dict[tuple[int, int], dict[int, tuple[str, bool]]] = {}  # those that this call has looked at

        def block(at: tuple[int, int]) -> dict[int, tuple[str, bool]]:
            if at not in blocks:
                held = self.waiting.getValue(at) if self.waiting.containsKey(at) else ((), (), ())
                blocks[at] = {int(p): (m, bool(h)) for p, m, h in zip(*held, strict=True)}
            return blocks[at]

        for page in rows:
            for feed, position, mbid, heard in zip(page["feed"], page["position"], page["mbid"], page["heard"], strict=True):
                if feed not in self.feeds:
                    raise ValueError(f"unknown feed: {feed!r}")
                place, position = self.feeds.index(feed), int(position)
                if mbid is None:
                    ends[place] = position
                elif position >= next_[place]:
                    block((place, position // BLOCK))[position] = (mbid, bool(heard))
        out, shown = [], {}
        while (place := next((f for f in (*range(turn, count), *range(turn)) if next_[f] != ends[f]), None)) is not None:
            spot, at = next_[place], (place, next_[place] // BLOCK)
            row = block(at).pop(spot, None)
            if row is None:
                break  # this feed's next page is still to come
            read, turn, next_[place] = read + 1, place + 1, spot + 1
            if next_[place] % BLOCK == 0:  # read to its end
                del blocks[at]
                self.waiting.removeKey(at)
            mbid, heard = row
            if self.unlistened and heard:
                continue
            if mbid not in shown:
                shown[mbid] = self.shown.containsKey((mbid,))
            if shown[mbid]:
                continue
            shown[mbid] = True
            self.shown.updateValue((mbid,), (read,))
            out.append((int(key[0]), read, self.feeds[place], mbid))
            if len(out) == ROWS:
                yield pd.DataFrame(out, columns=["listener", "index", "feed", "mbid"])
                out = []
        for at, held in blocks.items():
            if held:
                self.waiting.updateValue(at, (list(held), [m for m, _ in held.values()], [h for _, h in held.values()]))
            else:
                self.waiting.removeKey(at)
        self.at.update((turn, read, next_, ends))
        yield pd.DataFrame(out, columns=["listener", "index", "feed", "mbid"])

    def close(self) -> None:
        pass


def merge(pages: DataFrame, feeds: list[str], unlistened: bool = False) -> DataFrame:
    """The merged stream of each listener; the session's state store must be ``ROCKSDB``."""
    return pages.groupBy("listener").transformWithStateInPandas(Merge(feeds, unlistened), MERGED, "Append", "None")


def merge_files(spark, folder: str, out: str, checkpoint: str, feeds: list[str], skip: DataFrame | None = None, unlistened: bool = False):
    """Merge the pages in ``folder`` that were not read yet and append what they show to ``out``; keys of ``skip`` are never shown."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:  # a query keeps the settings that it starts with
        pages = spark.readStream.schema("listener long, feed string, position long, mbid string, heard boolean").option("maxFilesPerTrigger", 16).parquet(folder)
        shown = merge(pages, feeds, unlistened)
        if skip is not None:
            # A skipped key takes its index and shows nothing, whether it comes first or again.
            shown = shown.join(skip.select("mbid").distinct(), "mbid", "left_anti")
        return shown.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
