"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Guarded, chunks, stored, text_bytes

#: A-Z to lower case; digits, a-z and all bytes beyond ASCII kept; everything else parts words.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: Words in a block of the shift tables.
BLOCK = 2


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class _Tables:
    """Shift table and suffix buckets for patterns of one length."""

    length: int
    block: int
    shift: dict = field(default_factory=dict)
    buckets: dict = field(default_factory=lambda: defaultdict(dict))


class WuManber:
    """Finds every occurrence of the given word sequences.

    Patterns are dealt by length.  For a length m, the shift table gives for each block of two
    words how far the search may move when the window's end lies on that block; a block
    in no pattern moves it by m - 1.  Where the shift is zero, the block is the suffix of
    some patterns: their bucket is looked up and its patterns compared with the text.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]]):
        self.number: dict[bytes, int] = {}
        self.tables: list[_Tables] = []
        by_length: dict[int, list] = defaultdict(list)
        for pattern, owners in patterns.items():
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in pattern)
            by_length[len(ids)].append((ids, owners))
        for m, group in sorted(by_length.items()):
            block = min(BLOCK, m)
            t = _Tables(m, block)
            for ids, owners in group:
                for end in range(block, m + 1):
                    key = ids[end - block : end]
                    t.shift[key] = min(t.shift.get(key, m), m - end)
                t.buckets[ids[m - block :]].setdefault(ids, set()).update(owners)
            self.tables.append(t)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The (start, end) of each occurrence, and the owners of the patterns that occur."""
        ids = tuple(map(self.number.get, words, repeat(0)))
        spans: list[tuple[int, int]] = []
        owners: set[int] = set()
        n = len(ids)
        for t in self.tables:
            m, block, shift, buckets = t.length, t.block, t.shift.get, t.buckets
            far, end = m - block + 1, m
            while end <= n:
                key = ids[end - block : end]
                step = shift(key, far)
                if step:
                    end += step
                    continue
                owned = buckets[key].get(ids[end - m : end])
                if owned is not None:
                    spans.append((end - m, end))
                    owners |= owned
                end += 1
        return spans, owners


def windows(words: list[bytes], size: int = 10) -> Iterator[tuple[bytes, ...]]:
    """Every ``size`` consecutive words; a shorter sequence is one window, an empty one none."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "n_words long, n_hit long, spans array<struct<a: long, b: long>>, item_ids array<string>"
_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
#: Blocks of items that are sent and searched in one pass over the texts; further ones take further passes.
READY = 8


def _hits(blocks, size: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=READY)
        def search(k: int) -> tuple[WuManber, list[str | None]]:
            patterns: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
            for number, (_, text) in enumerate(blocks[k].value):
                for window in windows(words_of(text), size):
                    patterns[window].add(number)
            return WuManber(patterns), [name for name, _ in blocks[k].value]

        for batch in batches:
            at = 0
            for texts in chunks(t.as_py() for t in batch.column(len(kept))):
                split = [words_of(t) for t in texts]
                spans: list[list] = [[] for _ in split]
                items: list[set] = [set() for _ in split]
                for k in range(len(blocks)):
                    tables, names = search(k)
                    for i, words in enumerate(split):
                        more, owners = tables.find(words)
                        spans[i] += more
                        items[i].update(names[o] for o in owners)
                united = [_union(s) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(at, len(texts)) for i in range(len(kept))),
                        pa.array(map(len, split), pa.int64()),
                        pa.array((sum(b - a for a, b in s) for s in united), pa.int64()),
                        pa.array([[{"a": a, "b": b} for a, b in s] for s in united], _SPAN),
                        pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())),
                    ],
                    [*kept, "n_words", "n_hit", "spans", "item_ids"],
                )
                at += len(texts)

    return run


def _item_blocks(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The test items in blocks of about ``most_bytes`` of text, read one after another."""
    block, size = [], 0
    for name, text in items.select(F.col("item_id").cast("string"), text_bytes()).toLocalIterator():
        block.append((name, bytes(text)))
        size += len(text)
        if size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of several passes made one for each text."""
    for batch in batches:
        spans = [_union((x["a"], x["b"]) for x in found) for found in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2],
                pa.array((sum(b - a for a, b in s) for s in spans), pa.int64()),
                pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], _SPAN),
                batch.column(3),
            ],
            ["key", "n_words", "n_hit", "spans", "item_ids"],
        )


def _searched(g: Guarded, kept: list[str], items: DataFrame, size: int, block_bytes: int) -> DataFrame:
    """``kept`` columns and what was found; driver and tasks hold the blocks of one pass at a time."""
    context = g.df.sparkSession.sparkContext
    chosen = g.df.select(*kept, text_bytes(g["text"]).alias("_bytes"))
    blocks = _item_blocks(items, block_bytes)

    def searched(texts: DataFrame, sent: list) -> DataFrame:
        outer = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
        return texts.mapInArrow(_hits(sent, size, texts.columns[:-1]), f"{outer}, {_FOUND}")

    sent = [context.broadcast(b) for b in islice(blocks, READY)]
    further = next(blocks, None)
    if further is None:
        return searched(chosen, sent)
    keyed = stored(chosen.withColumn("_key", F.monotonically_increasing_id()))
    parts = [stored(searched(keyed.select("_key", "_bytes"), sent))]
    while further is not None:
        for block in sent:
            block.destroy()
        sent = [context.broadcast(b) for b in (further, *islice(blocks, READY - 1))]
        parts.append(stored(searched(keyed.select("_key", "_bytes"), sent).where("n_hit > 0")))
        further = next(blocks, None)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    found = reduce(DataFrame.unionAll, parts).groupBy("_key").agg(F.max("n_words"), F.flatten(F.collect_list("spans")), ids)
    found = found.mapInArrow(_united, f"_key long, {_FOUND}")
    return keyed.join(found, "_key").select(*kept, "n_words", "n_hit", "spans", "item_ids")


def search(docs: DataFrame, items: DataFrame, columns: list[str], size: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """``docs[columns]`` with ``n_words, n_hit, spans, item_ids``, one row for each row of ``docs(.., text)``.

    A window is ``size`` consecutive words of an item (``item_id, text``); a shorter item is one
    window.  A word of a document is hit if it lies in any occurrence of a window; ``spans`` are
    the hit stretches of words.  ``item_ids`` are the items with occurring windows, as
    strings in order; items without id mark words but aren't listed, and items with the same id
    count once.  Null texts and texts without words have no words and no hits; repeated documents give
    repeated rows; an empty table of items gives no hits.

    Items are searched in blocks of about ``block_bytes`` of text (the longest item at least), eight in a pass
    over the texts: a task holds the tables of one pass only, whatever the number of items, and builds each once.
    """
    g = Guarded(docs)
    found = _searched(g, [g[c] for c in columns], items, size, block_bytes)
    return found.toDF(*columns, "n_words", "n_hit", "spans", "item_ids")


def keep_clean(docs: DataFrame, items: DataFrame, size: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """The documents without any window of ``items``; all columns kept."""
    g = Guarded(docs)
    return g.restored(_searched(g, g.df.columns, items, size, block_bytes).where("n_hit = 0"))
