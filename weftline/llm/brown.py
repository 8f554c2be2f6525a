"""Class-based bigram language model in the manner of Brown et al. (1992), classes by exchange.

The corpus is counted as a whole and every training word has a class.  The most frequent words are clustered first; then
all words of the vocabulary move in rounds, each to the class that fits its contexts best.  What grows with the vocabulary,
the table of words with their counts and classes, is stored and joined; only the ``listed`` most frequent words are sent to the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, crc_mod, dropped, released, stored, text_bytes, tidied

#: The end of a text.  Words hold no white space, so it is none of them.
END = b"\n"
#: Bytes of a listed word at most, so that the list is bounded; longer words are told by the table, as rarer ones are.
LONGEST = 256
#: Distinct words that a counting task holds before it passes them on, and contexts that are counted at a time.
HELD, CONTEXTS = 600_000, 3_000_000
#: Counts below this are looked up when gains are computed.
SMALL = 16
#: Tokens from which the contexts of a word are added up before they are gathered.
OFTEN = 1 << 20


@dataclass(frozen=True)
class Settings:
    listed: int = 1 << 18  #: words sent to every task; they are the neighbours that later rounds look at
    core: int = 2048  #: words that are clustered first, over their full bigram counts
    classes: int = 0  #: classes, that of the text's end included (0: the cube root of the number of words, 8 to 96)
    sweeps: int = 6  #: exchange sweeps over the core at most
    rounds: int = 2  #: exchange rounds over the whole vocabulary; the first looks at core neighbours only
    weight: float = 0.93  #: share of the class model; the rest is the unigram model
    prior: float = 2.0  #: pseudo-transitions that follow the class frequencies


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"]
        )
        seen.clear()
        return batch

    for batch in batches:
        for text in batch.column(0):
            seen.update(text.as_py().lower().split())
            seen[END] += 1
            if len(seen) > HELD:
                yield out()
    if seen:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over all ``texts(b)``, the end of each text included."""
    return texts.select("b").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _encoded(listed):
    """Texts as numbers: of the list (from 0), or, below 0, of the text's other words (-1 the first), which come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(listed.value)}
        key = (TaskContext.get().partitionId() + 1) << 40
        for batch in batches:
            at = 0
            for texts in chunks(t.as_py() for t in batch.column(2)):
                numbers, others = [], []
                for text in texts:
                    words = text.lower().split()
                    words.append(END)
                    ids = np.array(list(map(known.get, words, repeat(-1))), "<i4")
                    own: dict[bytes, int] = {}
                    for i in np.flatnonzero(ids < 0).tolist():
                        ids[i] = own.setdefault(words[i], -1 - len(own))
                    numbers.append(ids.tobytes())
                    others.append(list(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(key, key + len(texts)), pa.int64()),
                        *(batch.column(i).slice(at, len(texts)) for i in (0, 1)),
                        pa.array(numbers, pa.binary()),
                        pa.array(others, pa.list_(pa.binary())),
                    ],
                    ["key", "doc_id", "held_out", "ids", "others"],
                )
                key += len(texts)
                at += len(texts)
            released()

    return run


def word_id(word):
    """Words beyond the list are told by 64 bits."""
    return F.xxhash64(word)


def encoded(docs: DataFrame, listed: list[bytes]) -> DataFrame:
    """``docs(doc_id, held_out, b)`` with their words numbered: ``(key, doc_id, held_out, ids, others)``, others as :func:`word_id`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(listed)
    rows = docs.select("doc_id", "held_out", "b").mapInArrow(
        _encoded(sent), f"key long, doc_id {kind}, held_out boolean, ids binary, others array<binary>"
    )
    return stored(rows.withColumn("others", F.transform("others", word_id)))


def _joined(batch: pa.RecordBatch, ids: str = "ids") -> Iterator[tuple[slice, np.ndarray, np.ndarray, list]]:
    """Groups of a batch's texts: their rows, numbers in a row, where each text starts, and for each text its first other word.

    Other words have numbers from -1 down over the whole group.
    """
    column, others = batch.column(ids), batch.column("others")
    at = 0
    for texts in chunks((t.as_py() for t in column), 1 << 21):
        rows = slice(at, at + len(texts))
        sizes = np.array([len(t) // 4 for t in texts])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        found = np.frombuffer(b"".join(texts), "<i4").astype(np.int64)
        part = others.slice(at, len(texts))
        more = np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
        first = np.concatenate(([0], np.cumsum(more)[:-1]))
        found = np.where(found < 0, found - np.repeat(first, sizes), found)
        yield rows, found, starts, part.flatten()
        at += len(texts)


def _summed(codes: np.ndarray) -> pa.RecordBatch:
    values, counts = np.unique(codes, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["code", "n"])


def _core_bigrams(core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for _, ids, starts, _ in _joined(batch):
                last = np.concatenate(([0], ids[:-1]))
                last[starts] = 0
                both = (ids >= 0) & (last >= 0) & (ids < core) & (last < core)
                waiting.append(last[both] * core + ids[both])
                size += len(waiting[-1])
                if size >= CONTEXTS:
                    yield _summed(np.concatenate(waiting))
                    waiting, size = [], 0
        if size:
            yield _summed(np.concatenate(waiting))

    return run


def _packed(codes: np.ndarray, counts: np.ndarray, at: np.ndarray) -> pa.Array:
    """Codes and counts in pairs, the pairs from each place ``at`` on as one binary value."""
    flat = np.stack((codes, counts), axis=1).astype("<i4").tobytes()
    ends = np.append(at, len(codes)) * 8
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(flat)])


def _contexts(sent, width: int, core: int, first: int, last: int):
    """For each word its contexts' codes (class before, class after), ``width`` for a neighbour without class, and their counts.

    Words from number ``first`` to ``last`` of the list, and all others if ``last`` is None.  Of core words, either side is
    counted alone: that takes fewer pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, names = sent.value
        of = np.append(classes, width)
        pairs = (width + 1) ** 2
        held: list[np.ndarray] = []
        size, wide = 0, 2 * (width + 1)
        sides = np.zeros(core * wide, np.int64)  # of core words: each class before, each class after

        def out(keys: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
            keys, counts = np.unique(keys, return_counts=True)
            word, code = keys // pairs, keys % pairs
            at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(words[word[at]]), _packed(code, counts, at)], ["id", "seen"])

        for batch in batches:
            for _, ids, starts, others in _joined(batch):
                now = np.where(ids >= 0, of[np.maximum(ids, -1)], width)
                before = np.concatenate(([0], now[:-1]))
                before[starts] = 0
                after = np.append(now[1:], 0)
                wanted = (ids >= first) if last is None else (ids >= first) & (ids < last)
                some, b, a = ids[wanted], before[wanted], after[wanted]
                often = some < core
                sides += np.bincount(some[often] * wide + b[often], minlength=len(sides)) + np.bincount(some[often] * wide + width + 1 + a[often], minlength=len(sides))
                keys = (some * pairs + b * (width + 1) + a)[~often]
                held.append(keys[keys % pairs != pairs - 1])
                size += len(held[-1])
                if last is None and len(others):
                    rare = ids < 0
                    words, at = np.unique(others.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
                    keys = at[-1 - ids[rare]] * pairs + before[rare] * (width + 1) + after[rare]
                    keys = keys[keys % pairs != pairs - 1]
                    if len(keys):
                        yield out(keys, words)
                if size >= CONTEXTS:
                    yield out(np.concatenate(held), names)
                    held, size = [], 0
            released()
        if size:
            yield out(np.concatenate(held), names)
        at = np.flatnonzero(sides)
        word, side = at // wide, at % wide
        code = np.where(side <= width, side * (width + 1) + width, width * (width + 1) + side - width - 1)
        told = code != pairs - 1
        word, code, counts = word[told], code[told], sides[at][told]
        if len(word):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(names[word[starts]]), _packed(code, counts, starts)], ["id", "seen"])

    return run


def _seen(texts: DataFrame, sent, width: int, core: int, first: int, counts: np.ndarray) -> DataFrame:
    """``(id, seen)``: the contexts of each word as packed pairs, in several rows.

    Words of very many tokens are added up by context first; of the others, each token is one pair at most.
    """
    often = max(first, int((counts >= OFTEN).sum()))
    rows = texts.mapInArrow(_contexts(sent, width, core, often, None), "id long, seen binary")
    if often == first:
        return rows

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.frombuffer(x.as_py(), "<i4").reshape(-1, 2) for x in batch.column(1)]
            flat = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int32)
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int64))], ["id", "code", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            while len(code):  # counts beyond 31 bits go in several pairs
                part = np.minimum(n, (1 << 31) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), _packed(code, part, np.arange(len(code)))], ["id", "seen"])
                n = n - part
                keep = n > 0
                batch, code, n = batch.filter(pa.array(keep)), code[keep], n[keep]

    found = texts.mapInArrow(_contexts(sent, width, core, first, often), "id long, seen binary").mapInArrow(parts, "id long, code int, n long")
    found = found.groupBy("id", "code").agg(F.sum("n").alias("n")).mapInArrow(packed, "id long, seen binary")
    return rows.unionAll(found)


def _transitions(sent, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sent.value
        total = np.zeros(width**2, np.int64)
        for batch in batches:
            for rows, ids, _, _ in _joined(batch):
                now = _looked_up(ids, classes, _flat(batch, "ks", rows))
                seen = now >= 0
                total += np.bincount(_before(now)[seen] * width + now[seen], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    return run


def _flat(batch: pa.RecordBatch, name: str, rows: slice) -> np.ndarray:
    return batch.column(name).slice(rows.start, rows.stop - rows.start).flatten().to_numpy(zero_copy_only=False)


def _looked_up(ids: np.ndarray, listed: np.ndarray, others: np.ndarray) -> np.ndarray:
    both = np.concatenate((listed, others[::-1]))  # so that -1 is the first of the others
    return both[ids]


def _before(classes: np.ndarray) -> np.ndarray:
    """For each token the class of the nearest token before it that training saw (unseen ones are -1).

    Every text ends with END (class 0), so nothing is carried from one text to the next, and
    a text's first token follows class 0.
    """
    at = np.where(classes >= 0, np.arange(len(classes)), -1)
    last = np.concatenate(([-1], np.maximum.accumulate(at)[:-1]))
    return np.where(last >= 0, classes[last], 0)


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Exchange clustering: the class of each word, given its bigram counts.

    Word 0 (the text's end) stays alone in class 0.  The other words start dealt out in order
    of frequency; each in turn moves to the class that gives the greatest likelihood of the
    class bigrams, until a sweep moves none.  Ties go to the lowest class.
    """
    n = len(bigrams)
    others = max(1, classes - 1)
    of = np.concatenate(([0], 1 + np.arange(n - 1) % others))
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    to, by = bigrams @ one, bigrams.T @ one  # counts of each word before, and after, each class
    cells = one.T @ to
    rows, columns = cells.sum(1), cells.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in range(1, n):
            a, self_ = of[w], bigrams[w, w]
            r, l = to[w].copy(), by[w].copy()
            r[a] -= self_
            l[a] -= self_
            cells[a] -= r
            cells[:, a] -= l
            cells[a, a] -= self_
            rt, lt = r.sum() + self_, l.sum() + self_
            rows[a] -= rt
            columns[a] -= lt
            gain = (_g(cells + r) - _g(cells)).sum(1) + (_g(cells.T + l) - _g(cells.T)).sum(1)
            d = np.diagonal(cells)
            gain += _g(d + r + l + self_) - _g(d + r) - _g(d + l) + _g(d)
            gain -= _g(rows + rt) - _g(rows) + _g(columns + lt) - _g(columns)
            gain[0] = -np.inf
            b = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else a
            cells[b] += r
            cells[:, b] += l
            cells[b, b] += self_
            rows[b] += rt
            columns[b] += lt
            if b != a:
                of[w] = b
                moved += 1
                to[:, a] -= bigrams[:, w]
                to[:, b] += bigrams[:, w]
                by[:, a] -= bigrams[w]
                by[:, b] += bigrams[w]
        if not moved:
            break
    return of


def joining_gains(cells: np.ndarray, words: np.ndarray, codes: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each word (row) and class (column) what the likelihood gains if the word joins that class.

    ``words`` number the words from 0, in order; ``codes`` are (class before, class after) with ``len(cells)`` for none.
    ``own`` is each word's class now (-1: none yet); for it, the gain of having the word is taken, so that to stay costs nothing.
    Other words are taken as they are: all words of a round choose at once.
    """
    width, n = len(cells), len(own)
    gain = np.zeros((n, width))
    for side, table in ((codes // (width + 1), cells), (codes % (width + 1), cells.T)):
        # Before: how often each class follows that class.  After: how often each class precedes that one.
        there = side < width
        key, inverse = np.unique(words[there] * width + side[there], return_inverse=True)
        x = np.bincount(inverse, weights=counts[there], minlength=len(key))
        w, c = key // width, key % width
        totals = np.bincount(w, weights=x, minlength=n)
        g_table = _g(table)
        # Most counts are small: what they gain is looked up.
        small = np.stack([_g(table + n) - g_table for n in range(SMALL)])
        for lot in range(0, len(key), 1 << 14):
            part = slice(lot, lot + (1 << 14))
            few = x[part] < SMALL
            add = small[np.where(few, x[part], 0).astype(np.int64), c[part]]
            much = np.flatnonzero(~few)
            add[much] = _g(table[c[part][much]] + x[part][much, None]) - g_table[c[part][much]]
            mine = own[w[part]]
            at = np.flatnonzero(mine >= 0)
            have = table[c[part][at], mine[at]]
            add[at, mine[at]] = _g(have) - _g(np.maximum(have - x[part][at], 0))
            first = np.flatnonzero(np.concatenate(([True], w[part][1:] != w[part][:-1])))
            gain[w[part][first]] += np.add.reduceat(add, first, axis=0)
        sizes = table.sum(0)
        few = totals < SMALL
        add = (_g(sizes + np.arange(SMALL)[:, None]) - _g(sizes))[np.where(few, totals, 0).astype(np.int64)]
        add[~few] = _g(sizes + totals[~few, None]) - _g(sizes)
        at = np.flatnonzero(own >= 0)
        add[at, own[at]] = _g(sizes[own[at]]) - _g(np.maximum(sizes[own[at]] - totals[at], 0))
        gain -= add
    gain[:, 0] = -np.inf
    return gain


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of id, so that all rows of an id are together."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))
        if cut or (rest and rest[-1].column(0)[0].as_py() != ids[0]):
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _moved(sent, settled: bool, usual: int):
    """The class of each word after a round, from its row ``(id, c, k)`` and the rows of its contexts, which follow it.

    ``settled`` words with a class keep it, and END does always.  A word of which no neighbour has a class keeps its own,
    or joins the ``usual`` one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, end = sent.value
        for rows in _whole(batches):
            first = rows.column("c").is_valid().to_numpy()
            word = np.cumsum(first) - 1
            head = rows.filter(pa.array(first))
            ids, own = head.column("id").to_numpy(), head.column("k").to_numpy().astype(np.int64)
            seen = rows.filter(pa.array(~first)).column("seen").combine_chunks()
            if len(seen):
                ends = np.frombuffer(seen.buffers()[1], "<i4")[seen.offset : seen.offset + len(seen) + 1]
                pairs = np.frombuffer(seen.buffers()[2], "<i4", (ends[-1] - ends[0]) // 4, ends[0]).reshape(-1, 2).astype(np.int64)
                words = np.repeat(word[~first], np.diff(ends) // 8)
            else:
                pairs, words = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
            stays = (ids == end) | ((own >= 0) & settled) | (np.bincount(words, minlength=len(ids)) == 0)
            mine, to = ~stays[words], np.cumsum(~stays) - 1
            best = np.where(own >= 0, own, usual)
            if (~stays).any():
                old = own[~stays]
                gain = joining_gains(cells, to[words[mine]], pairs[mine, 0], pairs[mine, 1], old)
                top = np.argmax(gain, axis=1)
                keeps = (old >= 0) & (gain[np.arange(len(old)), np.maximum(old, 0)] >= gain.max(1) - 1e-9)
                best[~stays] = np.where(keeps, old, top)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(head.column("c").to_numpy()), pa.array(best.astype(np.int32))], ["id", "c", "k"])
            released()

    return run


@dataclass(frozen=True)
class Model:
    listed: list  #: the words sent to tasks, END first, then by falling count
    counts: np.ndarray  #: their counts
    classes: np.ndarray  #: their classes
    step: np.ndarray  #: probability of each class after each class
    emit: np.ndarray  #: 1 / tokens of each class
    total: int  #: training tokens (N)
    distinct: int  #: distinct training tokens (V)
    unseen: float  #: probability of a word that training didn't hold
    weight: float
    table: DataFrame  #: ``(id, c, k)`` of all words: counts and classes


@dataclass(frozen=True)
class _Start:
    """What is known when the words are counted."""

    table: DataFrame  #: ``(id, word, c)``
    listed: list
    ids: np.ndarray  #: of the listed words
    counts: np.ndarray
    total: int
    distinct: int
    once: int


def counted(texts: DataFrame, settings: Settings) -> _Start:
    table = stored(word_counts(texts).select(word_id("word").alias("id"), "word", "c"))
    word = F.col("word") != F.lit(END)
    row = table.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
        F.coalesce(F.sum(F.when(word & (F.col("c") == 1), 1)), F.lit(0)).alias("once"), F.coalesce(F.sum(F.when(~word, F.col("c"))), F.lit(0)).alias("ends"),
    ).first()
    top = table.where(word & (F.length("word") <= LONGEST)).orderBy(F.desc("c"), "word").limit(settings.listed).select("id", "word", "c").toArrow()
    end = texts.sparkSession.range(1).select(word_id(F.lit(END)).alias("id")).first()["id"]
    ids = np.concatenate(([end], top["id"].to_numpy())).astype(np.int64)
    counts = np.concatenate(([row["ends"]], top["c"].to_numpy())).astype(np.int64)
    return _Start(table, [END, *top["word"].to_pylist()], ids, counts, row["n"], row["v"], row["once"])


def train(texts: DataFrame, start: _Start, settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray, int]:
    """The ``(id, c, k)`` of all words, the listed words' classes and the number of classes, from encoded ``texts``."""
    spark = texts.sparkSession
    width = settings.classes or int(min(96, max(8, round(start.distinct ** (1 / 3)))))
    core = min(settings.core, len(start.listed))
    pairs = texts.mapInArrow(_core_bigrams(core), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # core * core at most
    bigrams = np.zeros(core * core)
    bigrams[pairs["code"].to_numpy()] = pairs["n"].to_numpy()
    bigrams = bigrams.reshape(core, core)
    classes = np.full(len(start.listed), width, np.int64)
    classes[:core] = exchange(bigrams, width, settings.sweeps)
    one = np.eye(width)[classes[:core]]
    cells = one.T @ bigrams @ one
    ids = start.ids

    seeds = spark.createDataFrame(pa.table({"id": ids[:core], "k": classes[:core].astype(np.int32)}))
    table = start.table.select("id", "c").join(F.broadcast(seeds), "id", "left").select("id", "c", F.coalesce("k", F.lit(-1)).alias("k"))
    # The class of most core words, and of any word of which no neighbour has a class.
    usual = int(1 + np.argmax(np.bincount(classes[1:core], minlength=width)[1:width])) if core > 1 else 1
    for turn in range(settings.rounds):
        sent = spark.sparkContext.broadcast((classes, ids))
        found = _seen(texts, sent, width, core, core if turn == 0 else 1, start.counts)
        if turn:
            cells = _cells(texts, classes, width)
        fit = spark.sparkContext.broadcast((cells, int(ids[0])))
        old = table
        movers = table.select("id", "c", "k", F.lit(None).cast("binary").alias("seen")).unionByName(found, allowMissingColumns=True)
        movers = movers.repartition("id").sortWithinPartitions("id", F.col("c").desc_nulls_last())
        table = stored(movers.mapInArrow(_moved(fit, turn == 0, usual), "id long, c long, k int"))
        if turn:
            dropped(old)
        listed = table.join(F.broadcast(spark.createDataFrame(pa.table({"id": ids, "at": np.arange(len(ids))}))), "id").select("at", "k").toArrow()
        classes[listed["at"].to_numpy()] = listed["k"].to_numpy()
        tidied(spark)
    if not settings.rounds:
        table = table.select("id", "c", F.when(F.col("k") < 0, usual).otherwise(F.col("k")).alias("k"))
    return table, np.where(classes < width, classes, usual), width


def _cells(texts: DataFrame, classes: np.ndarray, width: int) -> np.ndarray:
    """Counts of neighbouring classes of listed words."""
    sent = texts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.append(sent.value, width)
        total = np.zeros((width + 1) ** 2, np.int64)
        for batch in batches:
            for _, ids, starts, _ in _joined(batch):
                now = np.where(ids >= 0, of[np.maximum(ids, -1)], width)
                before = np.concatenate(([0], now[:-1]))
                before[starts] = 0
                total += np.bincount(before * (width + 1) + now, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    return _matrix(texts.mapInArrow(run, "code long, n long"), width + 1)[:width, :width]


def _matrix(cells: DataFrame, width: int) -> np.ndarray:
    rows = cells.groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # classes * classes rows
    out = np.zeros(width * width)
    out[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(width, width)


def resolved(texts: DataFrame, table: DataFrame) -> DataFrame:
    """Encoded texts with the classes ``ks`` (-1: not in training) and counts ``cs`` of their other words, found by a join."""
    each = texts.select("key", F.posexplode("others").alias("j", "id")).join(table.select("id", "k", "c"), "id", "left")
    entry = F.struct("j", F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("c", F.lit(0)).alias("c"))
    found = each.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("found"))  # one text's distinct words
    both = texts.join(found, "key", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<j: int, k: int, c: bigint>>")))
    return stored(both.select("doc_id", "held_out", "ids", "others", F.col("found.k").alias("ks"), F.col("found.c").alias("cs")))


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, classes, step, emit, total, distinct, unseen, weight = sent.value
        if not counts[0]:  # an end that training never saw is an unseen word
            classes = np.concatenate(([-1], classes[1:]))
        for batch in batches:
            for rows, ids, starts, _ in _joined(batch):
                now, c = _looked_up(ids, classes, _flat(batch, "ks", rows)), _looked_up(ids, counts, _flat(batch, "cs", rows))
                base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
                p = (1 - unseen) * c * (weight * step[_before(now), now] * emit[now] + (1 - weight) / max(total, 1))
                logs = np.log10(np.maximum(np.where(now >= 0, p, unseen), 1e-300))
                sums = [np.add.reduceat(x, starts) for x in ((now >= 0).astype(np.int64), base, logs)]
                size = rows.stop - rows.start
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(name).slice(rows.start, size) for name in ("doc_id", "held_out")),
                        pa.array(np.diff(np.append(starts, len(ids)))), pa.array(sums[0]), pa.array(np.full(size, total)), *map(pa.array, sums[1:]),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def fit(texts: DataFrame, resolved_texts: DataFrame, start: _Start, table: DataFrame, classes: np.ndarray, width: int, settings: Settings) -> Model:
    """Transition and emission probabilities of the classes, over all training tokens."""
    sent = texts.sparkSession.sparkContext.broadcast(classes)
    cells = _matrix(resolved_texts.where("NOT held_out").mapInArrow(_transitions(sent, width), "code long, n long"), width)
    sizes = np.zeros(width)
    for row in table.groupBy("k").agg(F.sum("c").alias("c")).collect():  # one for each class
        sizes[row["k"]] = row["c"]
    share = sizes / max(start.total, 1)
    step = (cells + settings.prior * share) / (cells.sum(1, keepdims=True) + settings.prior)
    unseen = max(start.once, 0.5) / (start.total + 1) if start.total else 1.0
    return Model(start.listed, start.counts, classes, step, 1 / np.maximum(sizes, 1), start.total, start.distinct, min(unseen, 1.0), settings.weight, table)


def learn(docs: DataFrame, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model of those ``docs(doc_id, held_out, b)`` that aren't held out, and all of them resolved for :func:`score`."""
    start = counted(docs.where("NOT held_out"), settings)
    texts = encoded(docs, start.listed)
    table, classes, width = train(texts.where("NOT held_out"), start, settings)
    ready = resolved(texts, table)
    model = fit(texts, ready, start, table, classes, width, settings)
    dropped(texts)
    return model, ready


def score(ready: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of resolved texts."""
    sent = ready.sparkSession.sparkContext.broadcast(
        (model.counts, model.classes, model.step, model.emit, model.total, model.distinct, model.unseen, model.weight)
    )
    kind = ready.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ready.mapInArrow(_scored(sent), schema)


def brown_scores(docs: DataFrame, folds: int = 10, held: int = 0, settings: Settings = Settings()) -> DataFrame:
    """Score every text with a class model learned from the rows whose ``crc32(doc_id) mod folds`` isn't ``held``.

    P(w | before) = (1 - u) * (weight * P(class | class before) * c(w) / c(class) + (1 - weight) * c(w) / N) for a
    word seen in training; any other word is one event of probability u, the share of the words
    seen once.  These sum to 1.  The class before is that of the nearest word before w that training saw.
    Every training word has a class, whatever its count or length, and its transitions count; the classes are found by exchange
    (see :func:`train`).

    A null text counts as empty (one token, its end); a null doc_id counts as empty
    text for the fold; without training rows every token has probability 1.  Repeated rows give
    repeated results and columns other than doc_id and text are ignored.
    """
    marked = docs.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), text_bytes().alias("b"))
    model, ready = learn(marked, settings)
    return score(ready, model)
