from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftline.llm import urls
from weftline.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"
ODD = [
    None, "", "no scheme", "http://", "http:///en/", "HTTP://Example.COM/en/1", "https://EXAMPLE.com:8080/en/7x", "https://com/en/", "https://com/EN/",
    "ftp://a.example.com?x=/en/", "x://a.net/de/8#y", "x://b.example.net/de/8?q", "x://badexample.net/de/8", "http://a.org/es/?q=://b.com/en/", "http://a.org#/es/",
    "mailto:x@y", "a://b://c.com/en/9", "http://ÄÖ.Org/es/ü", "http://a.com/en/\n/x", "http://example.com/en/7", "http://com./en/", "://x.org/es/", "http://.com/en/",
]


def slow_parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    at = min(ends, default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    ends = [path.index(c) for c in "?#" if c in path]
    return host, path[: min(ends, default=len(path))]


def slow_rule(host: str, path: str) -> tuple[str | None, str | None]:
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(61)
    words = ["river", "stone", "garden", "music", "paper", "casino", "spam", "cheap", "pills"]
    rows = [(i, u, None if i % 2 else "<p>odd</p>") for i, u in enumerate(ODD)]
    for i in range(100, 500):
        bad = rng.random() < 0.2
        name = "".join(rng.sample(words[5:] if bad else words[:5], 2))
        host = rng.choice(["", "www.", "blog."]) + name + rng.choice([".example.com", ".example.net", ".example.org"])
        rows.append((i, f"http://{host}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(1, 900)}", "<html><b>" + " ".join(rng.choices(words, k=20)) + "</b></html>"))
    return rows


def test_hosts_paths_and_rules(spark, pages):
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, PAGES), URL_RULES).collect()}
    assert len(got) == len(pages)
    for i, url, _ in pages:
        host, path = slow_parts(url)
        rule, verdict = slow_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (verdict or ("block" if got[i].score > 0 else "allow"))


BAD = ("casino", "spam", "cheap", "pills")


def test_method_blocks_concatenated_names(spark, pages):
    """Labels of half the pages; no host names a word by itself: they have to be split."""
    labels = [(i, int(any(w in u for w in BAD))) for i, u, _ in pages if i >= 100 and i % 2]
    got = urls.judge(spark.createDataFrame(pages, PAGES), [], spark.createDataFrame(labels, "page_id long, block int")).collect()
    for r in got:
        if r.page_id >= 100:
            assert (r.verdict == "block") == any(w in r.host for w in BAD), r
            assert set(r.host_words.split()) <= {"river", "stone", "garden", "music", "paper", *BAD, "www", "blog", "example", "com", "net", "org"}


def by_hand(docs: list) -> list:
    """Naive Bayes scores of (words, label) rows; rows labelled None are scored only."""
    vocabulary = {w for d, b in docs for w in d}
    count = {(w, k): sum(d.count(w) for d, b in docs if b is k) + 0.5 for w in vocabulary for k in (True, False)}
    total = {k: sum(count[w, k] for w in vocabulary) for k in (True, False)}
    prior = math.log((sum(b is True for _, b in docs) + 0.5) / (sum(b is False for _, b in docs) + 0.5))
    return [prior + sum(math.log(count[w, True] / total[True]) - math.log(count[w, False] / total[False]) for w in d) for d, _ in docs]


def words_of(text: str, counts: dict, total: float) -> list:
    """All words of a host or path by the split over the full counts, one run after another."""
    out = []
    for run in re.findall(r"[^\W\d_]+|\d+", text.lower()):
        out += ["0"] if run.isdigit() else urls.split_words(run, counts, total)
    return out


@pytest.mark.parametrize("given", [True, False])
def test_scores_against_naive_bayes_by_hand(spark, pages, given):
    """The words of hosts and paths are split over the full word counts; labels are the rules' verdicts, or given ones."""
    rows = [p for p in pages if p[0] >= 100]
    counts = Counter(w for _, _, html in rows for w in re.findall("[a-z]+", html.replace("html", "").replace("<b>", "").replace("</b>", "")))
    extra = max(1.0, 1e-5 * sum(counts.values()))
    total = sum(counts.values()) + extra * len(set(urls.HOST_WORDS.split()))
    for w in set(urls.HOST_WORDS.split()):
        counts[w] += extra
    labels = {i: i % 3 == 0 for i, _, _ in rows if i % 2}
    table = spark.createDataFrame([(i, int(b)) for i, b in labels.items()] + [(None, 1), (102, None)], "page_id long, block int") if given else None
    got = sorted(urls.judge(spark.createDataFrame(rows, PAGES), URL_RULES, table).collect(), key=lambda r: r.page_id)
    docs = []
    for i, url, _ in rows:
        host, path = slow_parts(url)
        verdict = slow_rule(host, path)[1]
        docs.append((words_of(host, counts, total) + words_of(path, counts, total), labels.get(i) if given else None if verdict is None else verdict == "block"))
    for r, score in zip(got, by_hand(docs), strict=True):
        assert r.score == pytest.approx(score)


def test_segmented_is_the_split_over_all_counts(spark):
    rng = random.Random(6)
    counts = {"".join(rng.choices("abc", k=rng.randint(1, 5))): float(rng.randint(1, 50)) for _ in range(60)}
    runs = sorted({"".join(rng.choices("abcd", k=rng.choice([1, 5, 20, 63, 64, 300, 1024]))) for _ in range(40)})
    table, total = spark.createDataFrame(list(counts.items()), "word string, c double"), sum(counts.values())
    got = urls.segmented(spark.createDataFrame([(r,) for r in runs], "run string"), table, total).collect()
    assert {r.run: r.words for r in got} == {r: urls.split_words(r, counts, total) for r in runs}


@pytest.mark.parametrize("run", ["ab", "thecat", "xyzzy", "catdog", "aaaa", "z"])
def test_split_is_the_best_of_all(run):
    counts = {"the": 50.0, "cat": 10.0, "dog": 9.0, "a": 5.0, "ab": 3.0, "catd": 1.0, "og": 1.0}

    def chance(word: str) -> float:
        return math.log(counts[word] / 100) if word in counts else -math.log(100) - 2.302585 * (len(word) - 1)

    best = max(
        sum(chance(run[a:b]) for a, b in zip((0, *cut), (*cut, len(run)), strict=True))
        for k in range(len(run)) for cut in combinations(range(1, len(run)), k)
    )
    words = urls.split_words(run, counts, 100)
    assert "".join(words) == run and sum(map(chance, words)) == pytest.approx(best)


def test_odd_tables(spark, pages):
    assert urls.judge(spark.createDataFrame([], PAGES), URL_RULES).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (1, "http://" + "x" * 70 + ".com/", ""), (1, "http://" + "x" * 70 + ".com/", "")], PAGES)
    rows = urls.judge(nulls.withColumns({c: F.lit("k") for c in ("key", "host", "path", "run", "words", "bad")}), URL_RULES).collect()
    assert len(rows) == 3 and {r.host_words.replace(" ", "") for r in rows if r.page_id == 1} == {"x" * 70 + "com"}
    long = spark.createDataFrame([(1, "http://a.com/" + "ab/" * 100_000, "<p>" + "word " * 200_000)], PAGES)
    assert urls.judge(long, URL_RULES).first().path.count("ab") == 100_000
    run = spark.createDataFrame([(1, "http://a.com/" + "ab" * 3_000, "<p>ab ab")], PAGES)
    assert urls.judge(run, URL_RULES).first().verdict == "allow"
