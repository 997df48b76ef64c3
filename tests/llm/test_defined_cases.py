"""Bytes that are no UTF-8, letters that are none, ids with several vectors, several item blocks, workers without the package."""

import os
import subprocess
import sys

import pytest

from lorekeep.llm import decontaminate, langid, mainhtml, pq, quality, simhash, tokens, toxicity

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture
def bad(spark):
    return spark.range(3).selectExpr("id AS doc_id", "if(id = 0, cast(unhex('61FF622078') AS string), 'a b c') AS text", "'en' AS lang")


def test_bytes_that_are_no_utf8_are_read(spark, bad):
    assert {r.doc_id for r in simhash.groups(bad).collect()} == {0, 1, 2}
    assert simhash.groups(bad, near=0.8).count() == 3 and simhash.representatives(bad, near=0.8).count() == 2
    assert langid.predict(bad, langid.train(bad, min_docs=1)).where("lang_pred = 'en'").count() == 3
    assert toxicity.score(bad, toxicity.train(bad.selectExpr("text", "1 AS label"))).count() == 3
    assert quality.resample(bad, bad.select("text")).count() == 3
    items = bad.selectExpr("doc_id AS item_id", "text")
    assert decontaminate.matches(bad, items).where("size(matches) > 0").count() == 3
    assert mainhtml.main_text(bad.selectExpr("doc_id AS page_id", "'http://a.b' AS url", "text AS html")).count() == 3
    paths = pytest.importorskip("public_tokenizers")
    assert tokens.token_counts(bad, paths.path("piece_bpe_32k.model")).count() == 3


def test_numerals_are_no_letters(spark):
    rows = [(k, f"lorp gnar tilk{k % 3}", "aa") for k in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(0, "² ½ Ⅷ ৴ 12", None), (1, "lorp² ½", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score > 0) for r in langid.predict(odd, model).orderBy("doc_id").collect()] == [("und", False), ("aa", True)]
    assert langid.letters("aéß字ª²½Ⅷb") == ["aéß字ª", "b"] and langid.letters("²") == []


def test_an_id_with_two_vectors_counts_each(spark):
    a, b, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 0.01
    rows = [(1, a, 5), (1, b, 5), (2, [1.0, near, 0.0], 5), (3, [near, 1.0, 0.0], 5), (4, [1.0, 0.0, near], 5), (4, a, 6)]
    got = pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4), (4, 2, 1)]


def test_item_blocks_one_after_another(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(6)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = decontaminate.matches(docs, items, block_chars=200)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert all([m.item_id for m in r.matches] == [r.doc_id] for r in got.collect())


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from lorekeep.llm import langid, ranked, runs, toxicity
docs = spark.createDataFrame([(k, "lorp gnar tilk quev " * (4 + k % 3), "aa") for k in range(20)], "doc_id long, text string, lang string")
seen = docs.rdd.mapPartitions(lambda rows: [__import__("importlib.util").util.find_spec("lorekeep") is None]).collect()
assert all(seen)
assert langid.predict(docs, langid.train(docs)).where("lang_pred = 'aa'").count() == 20
assert toxicity.score(docs, toxicity.train(docs.selectExpr("text", "doc_id % 2 AS label"))).count() == 20
assert runs.periodic_runs(docs).where("size(runs) = 1").count() == 20
assert ranked.search(ranked.build(docs), docs.selectExpr("doc_id AS item_id", "text").limit(1)).count() == 20
print("whole")
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.stdout.strip().endswith("whole"), done.stderr[-3000:]
