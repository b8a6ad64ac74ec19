"""Filling containers of fixed capacity with items of varying length.

Bounded-space packing: every partition keeps a fixed number of open windows for each kind of container, puts an
item into the window it fills best, and closes the fullest when none has room. Windows that are still open at the end of a
partition, as their names and sizes alone, move to a merging task for each group of partitions, where they are put together best-fit, the
largest first; this repeats, a group at a time, until one group is left. The number of windows is bounded by the partitions, not by the
corpus; items never move, but for those in windows that were merged, whose names are looked up once.

An item over the capacity is cut into pieces of exactly the capacity and a rest; all others stay whole. Items of
size 0 (null or empty texts) take no space and join a window that is closed already, or the one in hand.
Repeated rows are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, slices, spread
from .tokens import TOKENIZERS, ByteBPE, counter

#: Open windows of a kind in a partition, and partitions whose rests one task merges.
OPEN, GROUP = 1024, 64
#: Rows of the first pass: items in closed windows, items in open ones, and open windows with what they hold.
CLOSED, HELD, WINDOW = range(3)
SCHEMA = "what int, bin_kind string, bin_id string, item_id long, piece int, start_token long, n_tokens int, held int, fold int"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


class Windows:
    """Open windows of one kind. Rows of a closed window go to out; an open one holds no more items than its capacity."""

    def __init__(self, kind: str, capacity: int, name: str):
        self.kind, self.capacity, self.name, self.made = kind, capacity, name, 0
        self.rooms: list[int] = []  # of the open windows in rising order, and the windows beside them
        self.open: list[tuple[str, list]] = []
        self.last: str | None = None  # a closed window

    def new(self) -> str:
        self.made += 1
        return f"{self.name}-{self.made}"

    def put(self, row: tuple[int, int, int, int], out: list) -> None:
        """row: item_id, piece, start_token, n_tokens."""
        size = row[3]
        if not size:
            if self.last is None and not self.open:
                self.keep(self.capacity, (self.new(), []))
            out.append((CLOSED, self.kind, self.last, *row, None, None) if self.last else (HELD, self.kind, self.open[0][0], *row, None, None))
            return
        k = bisect_left(self.rooms, size)
        if k < len(self.rooms):
            room, window = self.rooms.pop(k), self.open.pop(k)
        else:
            if len(self.open) >= OPEN:
                self.rooms.pop(0)
                self.close(self.open.pop(0), out)
            room, window = self.capacity, (self.new(), [])
        window[1].append(row)
        if room == size:
            self.close(window, out)
        else:
            self.keep(room - size, window)

    def keep(self, room: int, window: tuple[str, list]) -> None:
        k = bisect_left(self.rooms, room)
        self.rooms.insert(k, room)
        self.open.insert(k, window)

    def cut(self, row: tuple[int, int, int, int], out: list) -> None:
        """A piece as large as the capacity."""
        self.last = self.new()
        out.append((CLOSED, self.kind, self.last, *row, None, None))

    def close(self, window: tuple[str, list], out: list) -> None:
        self.last = window[0]
        out += [(CLOSED, self.kind, window[0], *r, None, None) for r in window[1]]

    def rest(self, fold: int) -> list[tuple]:
        out = []
        for room, (name, rows) in zip(self.rooms, self.open):
            out += [(HELD, self.kind, name, *r, None, None) for r in rows]
            out.append((WINDOW, self.kind, name, None, None, None, None, self.capacity - room, fold))
        return out


def batches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=COLUMNS)


def pack(specs: list[tuple[str, str, int]], counts: Callable[[str], Callable]) -> Callable:
    """First pass over (item_id, text): count tokens, place, give closed rows and the rests."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        count = {t: counts(t) for t in {t for _, t, _ in specs}}
        kinds = [(t, Windows(k, c, f"{k}-{at}")) for k, t, c in specs]
        for whole in parts:
            for batch in slices(whole, whole.schema.names[1]):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                sizes = {t: f(texts) for t, f in count.items()}
                out: list[tuple] = []
                for t, w in kinds:
                    for size, i in sorted(zip(sizes[t], ids), key=lambda x: (-x[0], x[1] is None, x[1])):
                        piece = start = 0
                        while size > w.capacity:
                            w.cut((i, piece, start, w.capacity), out)
                            piece, start, size = piece + 1, start + w.capacity, size - w.capacity
                        w.put((i, piece, start, size), out)
                if out:
                    yield batches(out)
        for _, w in kinds:
            if rows := w.rest(at):
                yield batches(rows)

    return run


def merge(caps: dict[str, int], last: bool) -> Callable:
    """Put the windows of a group of partitions together. Rows: kind, a window's first name, the one it has now, what that holds (null if
    nothing more goes in), and the group."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[tuple[int, str, str], tuple[int, list[str]]] = {}
        for batch in parts:
            for kind, first, name, held, fold in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held is None:
                    rest.setdefault((-1, kind, name), (-1, []))[1].append(first)
                else:
                    rest.setdefault((fold, kind, name), (held, []))[1].append(first)
        out: list[tuple] = []
        rooms: dict[tuple[int, str], tuple[list[int], list[tuple[str, list[str]]]]] = {}
        for (fold, kind, name), (held, firsts) in sorted(rest.items(), key=lambda x: (-x[1][0], x[0])):
            if held < 0:
                out += [(kind, f, name, None, None) for f in firsts]
                continue
            free, made = rooms.setdefault((fold, kind), ([], []))
            k = bisect_left(free, held)
            room, window = (free.pop(k), made.pop(k)) if k < len(free) else (caps[kind], (name, []))
            window[1].extend(firsts)
            k = bisect_left(free, room - held)
            free.insert(k, room - held)
            made.insert(k, window)
        for (fold, kind), (free, made) in rooms.items():
            for room, (name, firsts) in zip(free, made):
                done = last or room <= caps[kind] // 50
                out += [(kind, f, name, None if done else caps[kind] - room, None if done else fold) for f in firsts]
        if out:
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["bin_kind", "bin_id", "now", "held", "fold"])

    return run


def pack_corpus(df: DataFrame, specs: list[tuple[str, str, int]], key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """specs: kind, tokenizer and capacity of each container (a handful). One row for each item or piece of one:
    bin_kind, bin_id, doc_id, piece, start_token, n_tokens."""
    spark = df.sparkSession
    shared_folder(spark)
    # Vocabularies (under 2 MB each) are read and hashed once, here.
    ready = {t: spark.sparkContext.broadcast(ByteBPE.load(t, folder)) for t in {t for _, t, _ in specs} if os.path.exists(os.path.join(folder, f"{t}.tiktoken"))}
    items = spread(df.select(F.col(key).cast("long").alias(key), text))
    # Counted once and written: rows of numbers, and a few windows for each partition.
    rows = items.mapInArrow(pack(specs, lambda t: counter(t, folder, ready.get(t))), SCHEMA).checkpoint()
    caps, width = {k: c for k, _, c in specs}, max(1, rows.rdd.getNumPartitions())
    schema = "bin_kind string, bin_id string, now string, held int, fold int"
    windows = rows.filter(F.col("what") == WINDOW).select("bin_kind", "bin_id", F.col("bin_id").alias("now"), "held", "fold")
    while True:
        groups = -(-width // GROUP)
        windows = windows.withColumn("fold", (F.col("fold") / GROUP).cast("int")).repartition(groups, "fold").mapInArrow(merge(caps, groups == 1), schema)
        if groups == 1:
            break
        width = groups
    names = windows.filter("now <> bin_id").select("bin_kind", "bin_id", "now")
    columns = ["bin_kind", "bin_id", F.col("item_id").alias(key), "piece", "start_token", "n_tokens"]
    closed = rows.filter(F.col("what") == CLOSED).select(*columns)
    held = rows.filter(F.col("what") == HELD).join(names, ["bin_kind", "bin_id"], "left").withColumn("bin_id", F.coalesce("now", "bin_id"))
    return closed.unionByName(held.select(*columns))


def fill_report(bins: DataFrame, specs: list[tuple[str, str, int]]) -> DataFrame:
    """Containers, items, tokens and share of used space of each kind."""
    cap = F.create_map(*[F.lit(x) for k, _, c in specs for x in (k, c)])
    per = bins.groupBy("bin_kind", "bin_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return per.groupBy("bin_kind").agg(
        F.count("*").alias("bins"), F.sum("items").alias("items"), F.sum("used").alias("tokens"),
        (F.sum("used") / (F.count("*") * F.first(cap[F.col("bin_kind")]))).alias("fill"), F.max("used").alias("most"),
    )
