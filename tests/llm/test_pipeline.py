from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from tests.llm.conftest import crowded, prose
from tests.llm.test_simhash import near_groups
from weftline.llm import mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    rng = random.Random(81)
    item = prose(rng, 14)
    rows = [(i, prose(rng, rng.randint(8, 40), lang), lang, f"src{rng.choice([0, 0, rng.randint(1, 5)])}") for i in range(300) for lang in [rng.choice(["en", "de", "fr"])]]
    rows += [(300 + i, rows[i][1], rows[i][2], "src9") for i in range(20)]  # exact copies
    rows += [(400 + i, prose(rng, 20) + " " + item, "en", "src1") for i in range(5)]  # leaks
    rows += [(500 + i, prose(rng, 20) + f" un.{i + 10}@mail.shop.com", "en", "src2") for i in range(5)]
    rows += [(600, None, "en", "src1"), (601, "12 34", "en", "src1"), (602, "", None, None), (None, prose(rng, 30), None, None)]
    path = tmp_path_factory.mktemp("sf")
    make_docs(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, item, str(path)


def test_stages_one_by_one(spark, folder):
    """Each stage's result against what it should do to its own input."""
    rows, item, path = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        after = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids = {r.doc_id for r in after}
        if name == "language_id":
            assert {r.doc_id for r in before} - ids == {600, 601, 602} and all(r.lang for r in after)
        elif name == "near_dedup":
            # Rows without id come last in a group.
            texts = {(r.doc_id is None, r.doc_id or 0): r.text for r in before}
            assert ids == {None if none else i for none, i in near_groups(texts).values()} and len(after) == len(ids)
        elif name == "decontamination":
            assert {r.doc_id for r in before} - ids == {400 + i for i in range(5)}
        elif name == "pii":
            assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
            assert not any("shop.com" in r.text for r in after) and all(r.n_chars == len(r.text) for r in after)
            changed = {r.doc_id for r in after} & {500 + i for i in range(5)}
            texts = {r.doc_id: r.text for r in before}
            assert all((r.text != texts[r.doc_id]) == (r.doc_id in changed) for r in after)
        else:
            con = duckdb.connect()
            spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/before_mixing")
            want = con.execute(f"SELECT doc_id, epoch FROM ({mixing.mixture_sql(documents=repr(path + '/before_mixing/*.parquet'))})").fetchall()
            got = Counter((r.doc_id, r.epoch) for r in after)
            assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in Counter(want).items() if k[0] is not None}
        before = after


def test_run_is_the_stages_in_order(spark, folder):
    assert [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "mixing"]
    got = corpus_pipeline.run(spark, folder[2]).collect()
    assert got and not {400, 401, 402, 403, 404, 600, 601, 602} & {r.doc_id for r in got}


def test_stages_pass_other_columns(spark, folder):
    rows, _, path = folder
    docs = crowded(spark.read.parquet(f"{path}/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        names = docs.columns
        docs = stage(spark, docs, path)
        assert docs.columns == names


def test_empty_tables(spark, empty_docs, folder):
    docs = empty_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[2])
        assert docs.count() == 0
