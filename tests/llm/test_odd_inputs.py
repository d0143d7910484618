"""Long, repeated and odd inputs, and measures on rows that no model was fitted on."""

import glob
import hashlib
import math

import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from tidewake.llm import byte_bpe, common, quality, token_files, topk, toxicity, urls, vocab  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BAD_URLS = """http://live-casino.example.com/en/9 http://xxx-adult.example.net/ https://a.example.org/casino/spins http://buy-viagra.example.com/ http://free-porn.example.org/video
http://online-bets.example.com/fr/3 http://poker-online.example.net/x http://loans-payday.example.org/ http://spam-farm2.example.com/de/1 http://crack-keygen.example.net/"""
GOOD_URLS = """http://news.city.example.com/en/3 https://docs.example.net/guide http://university.library.example.org/fr/12 http://blog.garden.example.com/2021/item.html https://www.weather.example.org/
http://museum.history.example.net/about http://forum.travel.example.org/en/7 https://school.science.example.com/de/2 http://music.theatre.example.net/es/9 http://journal.research.example.com/"""


def test_urls_held_out(spark):
    rows = [(i, u, y) for y, some in ((1, BAD_URLS), (0, GOOD_URLS)) for i, u in enumerate(some.split())]
    # .com has an allow rule for the root path, so the model's score is what is measured.
    got = urls.judge(spark.createDataFrame([(10 * y + i, u) for i, u, y in rows], "page_id long, url string")).collect()
    right = sum((r.score > 0) == (r.page_id >= 10) for r in got)
    assert right >= 18


def test_a_very_long_url(spark):
    u = "http://" + "a" * 30_000 + ".example.org/" + "casino/" * 20_000 + "?q"
    (r,) = urls.judge(spark.createDataFrame([(1, u)], "page_id long, url string")).collect()
    g = urls.grams(*urls.parts(u))
    bias, w = urls.train()
    assert r.score == math.floor(bias * math.sqrt(len(g))) + sum(w[x] for x in g)


def test_long_texts_through_all_encoders(spark):
    text = ("Ein längerer Satz, 12 Wörter; und noch einer! " * 9000) + "x" * 200_000 + " 中文" * 20_000
    frame = spark.createDataFrame([(1, text, "de", "", 0)], DOCS)
    ranks = P.path("byte_bpe_50k.tiktoken")
    (r,) = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(frame, ranks), ranks)).collect()
    ids = vocab.encode_text(vocab.from_ranks(ranks), text)
    assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    got = quality.judge(frame).collect()[0]
    assert got.n_words == len(text.split()) and got.base_failed


def test_token_files_prune_columns_row_groups_and_pages(spark, tmp_path):
    import pyarrow.parquet as pq

    text = " ".join(f"word{i}" for i in range(400))
    docs = spark.range(600).selectExpr("id as doc_id", f"concat('{text} ', id) as text").repartition(1)
    path = str(tmp_path / "t")
    token_files.write(docs, path, P.path("word_bpe_49k.json"), row_group_bytes=200_000, page_bytes=20_000, delta=True)
    files = [pq.ParquetFile(f) for f in glob.glob(f"{path}/*.parquet")]
    assert sum(f.metadata.num_row_groups for f in files) > len(files) > 0
    meta = token_files.read(spark, path, tokens=False)
    plan = meta._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1]
    some = spark.read.parquet(path).filter("doc_id between 100 and 103")
    assert "GreaterThanOrEqual(doc_id,100)" in some._jdf.queryExecution().executedPlan().toString()
    one, rest = some.collect(), {r.doc_id: r.n_tokens for r in meta.collect()}
    assert [len(r.tokens) for r in one] == [rest[r.doc_id] for r in one] and len(rest) == 600


def test_toxicity_with_repeated_labels_and_ids(spark):
    texts = [(i, "good day to you all my friends", "en", "", 0) for i in range(90)] + [(i, "good day to grobnik you all my friends", "en", "", 0) for i in range(90, 150)]
    docs = spark.createDataFrame([*texts, (1, "another text of the same id", "en", "", 0), (None, "no id", "en", "", 0), (2, "y" * 20_000, "en", "", 0)], DOCS)
    labels = spark.createDataFrame([*((i, 1 if i >= 90 else 0) for i in range(150)), (1, 0), (1, None), (95, 0), (None, 1), (3, 7)], "doc_id long, toxic int")
    rows, ys = toxicity.training_rows(docs, labels, F.lit(True))
    assert len(rows) == 150 and sum(ys) == 60 and rows.count("another text of the same id") == 1
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == docs.count() and all(r.predicted == ("grobnik" in t) for r, t in zip(sorted((r for r in got if r.doc_id and r.doc_id > 3), key=lambda r: r.doc_id), [t[1] for t in texts[4:]]))


def test_top_k_takes_many_blocks_of_queries(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    one, many = (sorted(map(tuple, topk.top_k(frame, F.lit(True), k=3, block=b).collect())) for b in (64, 7))
    assert one == many and len(one) == 180


def test_scratch_is_deleted_and_a_cluster_needs_a_shared_folder(spark):
    with common.Scratch(spark) as scratch:
        kept = scratch.materialise(spark.range(5), "test")
        assert kept.count() == 5 and glob.glob(scratch.paths[0].removeprefix("file:") + "/*.parquet")
    assert not glob.glob(scratch.paths[0].removeprefix("file:") + "/*")
