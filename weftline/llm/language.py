"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Guarded, bounded_sample, checkpointed, chunks, crc_mod, text_bytes

UNKNOWN = "und"

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi mr ne bn pa gu",
}


def family_of(lang: str) -> str:
    """The family of a language; one that isn't listed is a family of its own."""
    return next((name for name, members in FAMILIES.items() if lang.lower() in members.split()), lang)


@dataclass(frozen=True)
class Settings:
    per_language: int = 400  #: training documents of a language at most
    sample: int = 4000  #: training documents in all, at most (five of each language at least)
    languages: int = 128  #: languages that are learned, the most frequent ones; it bounds sample and model
    bits: int = 13  #: log2 of the number of hashed features
    orders: int = 4  #: longest n-gram, in bytes
    cost: float = 10.0  #: weight of training errors
    epochs: int = 30
    slope: float = 3.0  #: of the logistic curve that turns margins into scores


#: ASCII letters to lower case, bytes beyond ASCII as they are, anything else a blank.
_LETTERS = np.array(
    [b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8
)
_LETTER = re.compile(r"[^\W\d_]")
_STRETCH = 1 << 20


def features(text: bytes, bits: int, orders: int) -> np.ndarray:
    """Square roots of hashed byte n-gram counts, scaled to length 1.

    Long texts are read in stretches of a megabyte; n-grams across their borders aren't counted.
    """
    counts = np.zeros(1 << bits, np.int64)
    for at in range(0, max(1, len(text)), _STRETCH):
        codes = _LETTERS[np.frombuffer(text, np.uint8, min(_STRETCH, len(text) - at), at)]
        codes = codes[(codes != 32) | np.concatenate(([True], codes[:-1] != 32))].astype(np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for order in range(1, min(orders, len(codes)) + 1):
            gram = gram[: len(codes) - order + 1] * np.uint32(263) + codes[order - 1 :] + np.uint32(1)
            slots = (gram * np.uint32(2654435761)) >> np.uint32(32 - bits)
            counts += np.bincount(slots, minlength=1 << bits)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def _has_letter(text: bytes) -> bool:
    said = text.decode("utf-8", "replace")
    return any(c.isalpha() for c in (m[0] for m in _LETTER.finditer(said)))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float, epochs: int) -> np.ndarray:
    """Weights (the last is the offset) of an L1-loss SVM, by dual coordinate descent (Hsieh et al., 2008)."""
    x = np.hstack([x, np.full((len(x), 1), 0.3, x.dtype)])
    w, alpha, size = np.zeros(x.shape[1], np.float64), np.zeros(len(x)), (x * x).sum(1)
    limit = cost * len(y) / (2 * np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1)))  # classes weigh the same
    order = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-3:
            break
    w[-1] *= 0.3
    return w


@dataclass(frozen=True)
class Model:
    names: list  #: of families
    members: list  #: for each family its languages
    pairs: list  #: (group, i, j) of each weight column; group -1 holds the families
    weights: np.ndarray
    settings: Settings


def fit(x: np.ndarray, langs: list[str], settings: Settings) -> Model:
    """SVMs for each pair of families and for each pair of languages of one family."""
    names = sorted({family_of(v) for v in langs})
    members = [sorted({v for v in langs if family_of(v) == name}) for name in names]
    of, lang = np.array([names.index(family_of(v)) for v in langs]), np.array(langs)
    pairs, weights = [], []

    def separate(group: int, i: int, j: int, first: np.ndarray, second: np.ndarray) -> None:
        both = np.flatnonzero(first | second)
        pairs.append((group, i, j))
        weights.append(linear_svm(x[both], np.where(first[both], 1.0, -1.0), settings.cost, settings.epochs))

    for i, j in combinations(range(len(names)), 2):
        separate(-1, i, j, of == i, of == j)
    for group, known in enumerate(members):
        for i, j in combinations(range(len(known)), 2):
            separate(group, i, j, lang == known[i], lang == known[j])
    return Model(names, members, pairs, np.array(weights, np.float32).reshape(len(pairs), x.shape[1] + 1).T, settings)


def _winner(size: int, margins: list[tuple[int, int, float]]) -> tuple[int, float]:
    """The one with most votes (then the greatest sum of margins, then the first), and its least margin."""
    if size == 1:
        return 0, np.inf
    votes, total, least = [0] * size, [0.0] * size, [np.inf] * size
    for i, j, m in margins:
        votes[i if m >= 0 else j] += 1
        total[i] += m
        total[j] -= m
        least[i], least[j] = min(least[i], m), min(least[j], -m)
    best = max(range(size), key=lambda k: (votes[k], total[k], -k))
    return best, least[best]


def predict(text: bytes, model: Model) -> tuple[str, float]:
    """The language of a text and a score from 0 to 1, the product of a logistic curve of the
    two least margins; ``und`` and 0 if nothing was learned or the text has no letter."""
    if not model.names or not _has_letter(text):
        return UNKNOWN, 0.0
    out = np.zeros(0)
    if model.pairs:
        out = features(text, model.settings.bits, model.settings.orders) @ model.weights[:-1] + model.weights[-1]
    told = [(g, i, j, float(m)) for (g, i, j), m in zip(model.pairs, out, strict=True)]
    family, sure = _winner(len(model.names), [(i, j, m) for g, i, j, m in told if g == -1])
    lang, surer = _winner(len(model.members[family]), [(i, j, m) for g, i, j, m in told if g == family])
    curve = lambda m: 1 / (1 + np.exp(-model.settings.slope * min(m, 50.0)))
    return model.members[family][lang], float(curve(sure) * curve(surer))


def _vectors(bits: int, orders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = [], []
            for text in batch.column(1):
                x = features(text.as_py(), bits, orders)
                at.append(np.flatnonzero(x).astype(np.int32))
                value.append(x[at[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
                ["lang", "at", "value"],
            )

    return run


def train(labelled: DataFrame, settings: Settings = Settings(), seed: int = 0) -> Model:
    """Fit on a bounded sample of ``labelled(doc_id, lang, b)``; every language is learned, if there are no more than ``settings.languages``."""
    told = labelled.where("lang IS NOT NULL")
    names = told.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(settings.languages).select("lang")
    told = told.join(F.broadcast(checkpointed(names)), "lang", "left_semi")
    chosen = bounded_sample(told, "lang", settings.per_language, settings.sample, seed)
    rows = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").dropDuplicates(["doc_id", "lang"])
    found = rows.select("lang", "b").mapInArrow(_vectors(settings.bits, settings.orders), "lang string, at array<int>, value array<float>").toArrow()
    x = np.zeros((found.num_rows, 1 << settings.bits), np.float32)
    for row, (at, value) in enumerate(zip(found["at"], found["value"], strict=True)):
        x[row, at.values.to_numpy()] = value.values.to_numpy()
    return fit(x, found["lang"].to_pylist(), settings)


def _predicted(sent, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            at = 0
            for texts in chunks(t.as_py() for t in batch.column(len(kept))):
                told = [predict(t, model) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(at, len(texts)) for i in range(len(kept))),
                        pa.array([t[0] for t in told], pa.string()),
                        pa.array([t[1] for t in told], pa.float64()),
                    ],
                    [*kept, "lang_pred", "score"],
                )
                at += len(texts)

    return run


def _identified(g: Guarded, kept: list[str], folds: int, held: int, settings: Settings) -> DataFrame:
    marked = g.df.withColumn("_held", crc_mod(g["doc_id"], folds) == held)
    labelled = marked.where(~F.col("_held")).select(F.col(g["doc_id"]).alias("doc_id"), F.col(g["lang"]).alias("lang"), text_bytes(g["text"]).alias("b"))
    model = train(labelled, settings)
    chosen = marked.select(*kept, F.col("_held").alias("held_out"), text_bytes(g["text"]).alias("_bytes"))
    names = chosen.columns[:-1]
    outer = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    sent = g.df.sparkSession.sparkContext.broadcast(model)
    return chosen.mapInArrow(_predicted(sent, names), f"{outer}, lang_pred string, score double")


def identify(docs: DataFrame, columns: list[str], folds: int = 4, held: int = 2, settings: Settings = Settings()) -> DataFrame:
    """``docs[columns]`` with ``held_out, lang_pred, score``, one row for each row.

    Learns from text and lang of the rows whose ``crc32(doc_id) mod folds`` isn't ``held`` and whose
    lang isn't null, on a bounded sample of them (see :class:`Settings`; rows without doc_id aren't in it).  Of very many
    values of lang the 128 most frequent are learned, ties to the first by name; the others are never predicted.  Predictions
    depend on the text alone.  A null text, or one without letters, is ``und`` with score 0; so is
    everything if no lang is known.  Equal texts get equal results; other columns pass unseen.
    """
    g = Guarded(docs)
    found = _identified(g, [g[c] for c in columns], folds, held, settings)
    return found.toDF(*columns, "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.0, folds: int = 4, held: int = 2, settings: Settings = Settings()) -> DataFrame:
    """The documents whose language is told (not ``und``, score of ``least`` or more), all columns kept.

    A missing lang is filled in with the prediction.
    """
    g = Guarded(docs)
    told = _identified(g, g.df.columns, folds, held, settings).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return g.restored(told.withColumn(g["lang"], F.coalesce(g["lang"], "lang_pred")))
