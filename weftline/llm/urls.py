"""URL filters: rules, and naive Bayes over host names split into words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stored, text_bytes

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with its path.
Rule = tuple[str, str, str]

# Common words of host names, known to the word model beside those of the pages.
HOST_WORDS = (
    "best blog book buy cheap click daily deal direct download farm fast forum free game games global health home hot "
    "info live loan loans mail market media money news now online play shop site store top web win world"
)

#: Longest word of the word model, and the letters of a run that are split at a time (many times a host's label).
WORD, STRETCH = 20, 1024


@dataclass(frozen=True)
class Settings:
    known_share: float = 1e-5  #: chance added to each word of the list above
    smoothing: float = 0.5  #: added to each token count of the naive Bayes model


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct of the longest fitting rule's ``rule`` and ``verdict``, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_TAG = re.compile(rb"<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>", re.I | re.S)
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = [k.decode("utf-8", "ignore") for k in seen]
        batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
        seen.clear()
        return batch

    for batch in batches:
        for html in batch.column(0):
            seen.update(w for w in _TAG.sub(b" ", html.as_py()).translate(_LETTERS).split() if len(w) <= 4 * WORD)
            if len(seen) > 300_000:
                yield out()
    if seen:
        yield out()


def word_counts(pages: DataFrame, settings: Settings) -> tuple[DataFrame, float]:
    """``(word, c)`` over the text of all pages, with the known words' share added, and the total."""
    counts = pages.select(text_bytes("html").alias("b")).mapInArrow(_counted, "word string, c long")
    counts = counts.where(F.length("word") <= WORD).groupBy("word").agg(F.sum("c").cast("double").alias("c"))
    counts = stored(counts)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("t")).first()["t"]
    known = sorted(set(HOST_WORDS.split()))
    extra = pages.sparkSession.createDataFrame([(w, max(1.0, settings.known_share * total)) for w in known], "word string, c double")
    both = counts.unionAll(extra).groupBy("word").agg(F.sum("c").alias("c"))
    return stored(both), total + len(known) * max(1.0, settings.known_share * total)


def split_words(run: str, counts: dict[str, float], total: float) -> list[str]:
    """The most likely split of a run of letters under the unigram model (Viterbi; ties to the longer last word).

    A word without count has chance ``1 / (total * 10 ** (length - 1))``.
    """
    best = [(0.0, 0)] + [(-np.inf, 0)] * len(run)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - WORD), end):
            word = run[start:end]
            c = counts.get(word, 0.0)
            log_p = np.log(c / total) if c else -np.log(max(total, 1.0)) - 2.302585 * (len(word) - 1)
            if best[start][0] + log_p > best[end][0] + 1e-12:
                best[end] = (best[start][0] + log_p, start)
    words, end = [], len(run)
    while end:
        words.append(run[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in batch.column(0).to_pylist():
            parts = sorted({run[a:b] for a in range(len(run)) for b in range(a + 1, min(a + WORD, len(run)) + 1)})
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(parts)), pa.array(parts)], ["run", "word"])


def _split(total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(0).to_pylist()
            known = [{x["word"]: x["c"] for x in found or ()} for found in batch.column(1).to_pylist()]
            words = [split_words(r, k, total) for r, k in zip(runs, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    return run


def segmented(runs: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """``(run, words)`` for the distinct ``runs(run)`` of letters.

    The counts that a run's split needs, those of its substrings, are found by a join: the word model isn't sent anywhere.
    """
    found = runs.mapInArrow(_substrings, "run string, word string").join(counts, "word")
    found = found.groupBy("run").agg(F.collect_list(F.struct("word", "c")).alias("known"))  # WORD * STRETCH at most
    return stored(runs.join(found, "run", "left").select("run", "known").mapInArrow(_split(total), "run string, words array<string>"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = (TaskContext.get().partitionId() + 1) << 40
    for batch in batches:
        names = batch.schema.names
        keys = pa.array(range(key, key + batch.num_rows), pa.int64())
        yield pa.RecordBatch.from_arrays([keys, *batch.columns], ["key", *names])
        key += batch.num_rows


def _runs(text: Column) -> Column:
    """Runs of letters in lower case, in stretches of ``STRETCH`` at most, and ``0`` for each run of digits."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{1,{STRETCH}}}+|\d++"), F.lit(0)), lambda t: F.when(t.rlike(r"^\d"), "0").otherwise(t))


def judge(pages: DataFrame, rules: Sequence[Rule], labels: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score, host_words)``, one row for each row of ``pages(page_id, url, html)``.

    The longest fitting rule decides; without one, the naive Bayes model: ``block`` if the words of host and path are
    likelier in pages to block (``score``, the log-odds, above 0).  The model learns from ``labels(page_id, block)``, or, if
    none are given, from the pages that a rule fits, with the rule's verdict as their label; other pages
    don't count.  Words come from a unigram model of all pages' text.

    A null url, or one without ``://``, has empty host and path, fits no rule and has the score of the prior
    alone; without any label, all scores are 0 and such pages are allowed.  Runs of more than 1,024 letters are split in stretches of
    1,024, each on its own.  Null html has no words.  Repeated pages give repeated rows, each counted; of contradictory labels
    of one page, ``block`` holds; labels with nulls count for nothing; an empty table gives no rows; other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = stored(split.mapInArrow(_keyed, f"key long, page_id {kind}, host string, path string"))
    said = keyed.select("key", F.posexplode(_runs(F.col("host"))).alias("pos", "run"), F.lit(True).alias("of_host")).unionAll(
        keyed.select("key", F.posexplode(_runs(F.col("path"))).alias("pos", "run"), F.lit(False).alias("of_host"))
    )
    counts, total = word_counts(pages, settings)
    words = segmented(stored(said.select("run").distinct()), counts, total)
    tokens = stored(said.join(words, "run").select("key", "of_host", "pos", "words"))
    hosts = tokens.where("of_host").groupBy("key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("host_words")
    )
    hosts = keyed.select("key", "page_id").join(hosts, "key", "left")
    if labels is None:
        ruled = longest_rule(F.col("host"), F.col("path"), rules)["verdict"]
        told = keyed.select("key", (ruled == "block").alias("bad"))
    else:
        named = labels.where("page_id IS NOT NULL AND block IS NOT NULL").groupBy("page_id").agg(F.max(F.col("block").cast("boolean")).alias("bad"))
        told = keyed.select("key", "page_id").join(named, "page_id", "left").select("key", "bad")
    marked = stored(hosts.select("key", "host_words").join(told, "key"))

    seen = tokens.select("key", F.explode("words").alias("word"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = stored(seen.join(marked.select("key", "bad"), "key").groupBy("word").agg(one(F.col("bad")).alias("b"), one(~F.col("bad")).alias("a")))
    whole = sums.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("v")).first()
    size = marked.agg(F.coalesce(one(~F.col("bad")), F.lit(0)).alias("a"), F.coalesce(one(F.col("bad")), F.lit(0)).alias("b")).first()
    s = settings.smoothing
    log_odds = F.log((F.col("b") + s) / (whole["b"] + s * whole["v"])) - F.log((F.col("a") + s) / (whole["a"] + s * whole["v"]))
    scores = seen.join(sums.select("word", log_odds.alias("w")), "word").groupBy("key").agg(F.sum("w").alias("w"))
    prior = float(np.log((size["b"] + s) / (size["a"] + s)))
    score = F.coalesce("w", F.lit(0.0)) + prior
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    rows = keyed.join(marked.select("key", "host_words"), "key").join(scores, "key", "left")
    return rows.withColumn("_rule", rule).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"), F.array_join(F.coalesce("host_words", F.array().cast("array<string>")), " ").alias("host_words"),
    )
