"""Documents packed into containers of fixed capacity, neighbours together.

The documents are sorted into ranges of their places on a Hilbert curve, so that a container holds texts
that resemble each other; only ids, sizes and places are moved. Each range is packed in windows along
the curve, each as long as a few containers are large, by best fit, largest first, into the containers that
are still open. A container closes when no room is left or when the curve has gone on by some windows, so
that what it holds lies close together. A document larger than the capacity alone fills whole containers and
goes on as its remainder. Equal places are told apart by the id, so copies of one text spread over ranges.

Defined results: documents without tokens come with a null container; a null or non-positive capacity
has no containers; capacities of the same name are one, the smallest; repeated rows are packed each.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtree.llm.tokens import TOKENIZER, token_sizes
from voxtree.session import materialize

#: Tokens of a window in containers, and for how many windows a container stays open. Larger ones fill better and mix texts
#: that are further apart.
WINDOW, AGE = 64, 6
_SCHEMA = "capacity_name string, container_id bigint, doc_id bigint, first_token bigint, n_tokens bigint, position bigint"
_NAMES = [f.split(" ")[0] for f in _SCHEMA.split(", ")]


class Packer:
    """Best fit in windows for one capacity; gives (container, document, first token, tokens, position)."""

    def __init__(self, capacity: int, first: int, window: int = WINDOW, age: int = AGE) -> None:
        self.capacity, self.next, self.size, self.age = capacity, first, window * capacity, age
        self.open: list[tuple[int, int, int]] = []  # room, container, window it was opened in
        self.held: list[tuple[int, int, int, int]] = []  # size, document, first token, position
        self.tokens = self.window = 0

    def pack(self, rows: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """Documents (id, tokens, position) in the order of the curve; what a window still lacks is held."""
        for doc, size, position in rows:
            at = 0
            while size - at > self.capacity:
                yield self.next, doc, at, self.capacity, position
                self.next, at = self.next + 1, at + self.capacity
            self.held.append((size - at, doc, at, position))
            self.tokens += size - at
            if self.tokens >= self.size:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[int, int, int, int, int]]:
        self.held.sort(key=lambda i: -i[0])
        for size, doc, at, position in self.held:
            k = bisect_left(self.open, (size, -1, -1))
            if k == len(self.open):
                room, container, since = self.capacity, self.next, self.window
                self.next += 1
            else:
                room, container, since = self.open.pop(k)
            if room > size:
                insort(self.open, (room - size, container, since))
            yield container, doc, at, size, position
        self.held, self.tokens, self.window = [], 0, self.window + 1
        self.open = [o for o in self.open if self.window - o[2] <= self.age]


def pack_documents(documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, age: int = AGE) -> DataFrame:
    """capacity_name, container_id, doc_id, first_token, n_tokens, position: a row for each document and capacity,
    or for each piece of a document that exceeds the capacity. position numbers the documents along the curve, within a
    range without gaps."""
    rows = capacities.where("capacity_name is not null and capacity_tokens > 0").groupBy("capacity_name").agg(F.min("capacity_tokens").alias("n")).collect()
    targets = sorted((r["capacity_name"], int(r["n"])) for r in rows)
    sizes = materialize(token_sizes(documents, tokenizer, True, "doc_id"))  # the ranges are sampled first
    order = ["place", "doc_id", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = position = TaskContext.get().partitionId() << 40
        packers = [(name, Packer(n, first, window, age)) for name, n in targets]

        def batch_of(name: str, placed: list[tuple]) -> Iterator[pa.RecordBatch]:
            if placed:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(placed)), *(pa.array(c, pa.int64()) for c in zip(*placed, strict=True))], _NAMES)

        for batch in batches:
            full, empty = [], []
            for doc, n in zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True):
                if n > 0:
                    full.append((doc, n, position))
                    position += 1
                else:
                    empty.append((None, doc, 0, 0, None))
            for name, packer in packers:
                yield from batch_of(name, [*packer.pack(full), *empty])
        for name, packer in packers:
            yield from batch_of(name, list(packer.flush()))

    return sizes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _SCHEMA)


def container_fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """capacity_name, n_containers, n_tokens, the share of the capacity that is used, and the mean distance along the
    curve, in documents, of those that follow each other in a container."""
    gap = (F.max("position") - F.min("position")).alias("gap")
    used = packed.where("container_id is not null").groupBy("capacity_name", "container_id").agg(F.sum("n_tokens").alias("n"), gap, (F.count(F.lit(1)) - 1).alias("steps"))
    sums = used.groupBy("capacity_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), (F.sum("gap") / F.sum("steps")).alias("mean_gap"))
    size = capacities.groupBy("capacity_name").agg(F.min("capacity_tokens").alias("_size"))
    return sums.join(size, "capacity_name").select("capacity_name", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("_size"))).alias("fill"), "mean_gap")
