"""The text operators against brute force, round trips and held-out labels, and on odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from tidewake.llm import byte_bpe, html_text, packing, pii, quality, queries, simhash, token_files, topk, toxicity, urls, vocab  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "part int, tokens string, key string, fp long, u long, component_id long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (4, "one", "fr", "b", 3),
    (5, "a b c d " * 6000, "de", "b", 48000),
    (6, "same words here and there again", "en", "c", 31),
    (7, "same words here and there again", "en", "c", 31),
    (7, "same words here and there again", "en", "c", 31),
    (None, "no id at all in this one", "en", "c", 24),
    (8, "\x00\x01 odd \u2028 text \U0001f600 é <|endoftext|>", "en", "c", 30),
    (9, "x" * 50000, "en", "d", 50000),
    (10, " " * 30000 + "end", "en", "d", 30003),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.selectExpr("*", "7 as part", "'x' as tokens", "'k' as key", "1L as fp", "2L as u", "3L as component_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return lambda x: t.encode(x, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# packing


def check_pieces(pieces, ids_of):
    cover = collections.defaultdict(list)
    place = []
    for p in pieces:
        ids = ids_of[p.doc_id]
        assert crc(ids[p.start : p.start + p.length]) == p.ids_crc32 and p.doc_tokens == len(ids)
        assert 0 < p.length and p.offset + p.length <= 2048
        cover[p.doc_id].append((p.start, p.length))
        place.append((p.sequence_id, p.offset, p.length))
    for d, ids in ids_of.items():
        assert sum(n for _, n in cover[d]) % len(ids) == 0
    place.sort()
    at = 0
    for s, o, n in place:
        assert (s, o) == divmod(at, 2048)
        at += n


def test_packing_covers_each_id_once(docs, texts):
    encode = library("byte_bpe_50k.json")
    pieces = packing.digests(packing.pack(docs, P.path("byte_bpe_50k.json"))).collect()
    check_pieces(pieces, {d: [*encode(t), 1] for d, t in texts.items()})


def test_packing_odd_rows(odd, empty):
    pieces = packing.digests(packing.pack(odd, P.path("byte_bpe_50k.json"))).collect()
    encode = library("byte_bpe_50k.json")
    check_pieces(pieces, {r[0]: [*encode(r[1] or ""), 1] for r in ODD})
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_added_tokens_are_those_of_the_library():
    words, pieces = token_files.word_encoder(P.path("word_bpe_49k.json")), vocab.from_byte_level_json(P.path("byte_bpe_50k.json"))
    a, b = library("word_bpe_49k.json"), library("byte_bpe_50k.json")
    rng = random.Random(4)
    some = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", " ", "  ", "\n", "word", "É", "Ω", "\u3000", "'s", "7"]
    texts = ["a <|endoftext|> b", "", "<|endoftext|>", *("".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(3000))]
    for t, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == a(t)
        assert vocab.around_added(P.path("byte_bpe_50k.json"), t, lambda x: vocab.encode_text(pieces, x)) == b(t)


# top-k


def brute_topk(rows, k):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    out = []
    for i in sorted(set(i for i, _ in rows if i % 5 == 0)):
        found = sorted((-sum(a * b for a, b in zip(q[i], [int(np.floor(256 * x)) for x in v])), j) for j, v in rows if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return out


@pytest.mark.parametrize("bins", [2, 64, 4096])
def test_topk_with_ties_and_bad_vectors(spark, bins):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(3)]) for i in range(120)]
    rows += [(60, None), (61, [1.0, None, 0.0]), (62, [float("nan"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (65, [float("inf"), 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).selectExpr("*", "1L as q", "2L as rank")
    got = topk.top_k(frame, F.col("vec_id") % 5 == 0, k=4, bins=bins, block=5).collect()
    assert sorted(map(tuple, got)) == sorted(brute_topk(rows, 4))


def test_topk_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], kind)
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 98304)]
    assert topk.top_k(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    assert topk.top_k(two.filter("vec_id = 0"), F.lit(True)).count() == 0


# token files


def test_token_files(spark, odd, empty, tmp_path):
    encode = library("word_bpe_49k.json")
    token_files.write(odd, str(tmp_path / "a"), P.path("word_bpe_49k.json"))
    got = token_files.digests(token_files.read(spark, str(tmp_path / "a"))).collect()
    want = sorted(([*encode(r[1] or ""), 2] for r in ODD), key=lambda x: (len(x), crc(x)))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == [(len(x), crc(x)) for x in want]
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
    token_files.write(empty, str(tmp_path / "b"), P.path("word_bpe_49k.json"), delta=True)
    assert token_files.read(spark, str(tmp_path / "b"), tokens=False).count() == 0


def test_token_files_format(spark, docs, texts, tmp_path):
    import glob

    import pyarrow.parquet as pq

    encode = library("word_bpe_49k.json")
    token_files.write(docs, str(tmp_path / "d"), P.path("word_bpe_49k.json"), delta=True)
    for r in token_files.read(spark, str(tmp_path / "d")).collect():
        assert r.tokens == [*encode(texts[r.doc_id]), 2]
    seen = set()
    for f in glob.glob(str(tmp_path / "d" / "*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            tokens = next(c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns)) if c.path_in_schema.startswith("tokens"))
            seen.update(tokens.encodings)
            assert tokens.has_offset_index
    assert "DELTA_BINARY_PACKED" in seen


# byte-level BPE


@pytest.mark.parametrize("chunk, overlap", [(200, 60), (32768, 2048)])
def test_byte_bpe(spark, odd, docs, texts, chunk, overlap):
    ranks = P.path("byte_bpe_50k.tiktoken")
    enc = vocab.from_ranks(ranks)
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, ranks, chunk_chars=chunk, overlap=overlap), ranks)).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    odd_rows = byte_bpe.encode(odd, ranks, chunk_chars=chunk, overlap=overlap).collect()
    want = sorted(tuple(vocab.encode_text(enc, r[1] or "")) for r in ODD)
    assert sorted(tuple(r.ids) for r in odd_rows) == want


def test_long_space_equals_library():
    enc = vocab.from_ranks(P.path("byte_bpe_50k.tiktoken"))
    for t in ("ab" + " " * 12000 + "cd", "\n" * 15000, " \n" * 8000 + "x", "a" + "\u3000" * 11000 + " b"):
        assert vocab.encode_text(enc, t) == enc.encode_ordinary(t)


# toxicity


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op4_toxicity(spark, folder).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id").toxic
    held = got[got.held_out].join(labels, how="inner")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got.held_out.items())
    hit = held[held.predicted == 1]
    assert (hit.toxic == 1).mean() >= 0.9 and (held[held.toxic == 1].predicted == 1).mean() >= 0.6


def test_toxicity_marginals_are_exact_in_segments():
    rng = np.random.default_rng(0)
    field = toxicity.Field(rng.normal(size=1 << toxicity.BITS), -1.0, np.array([-1.2, -1.2, 1.7]))
    w = toxicity.words_of([" ".join(rng.choice(["a1", "the", "of", "bad"], n)) for n in (0, 5, 1500, 9000)])
    assert np.abs(field.marginals(w, 4) - field._marginals(w, 4)).max() < 1e-9


def test_toxicity_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    field = toxicity.Field(rng.normal(size=1 << toxicity.BITS), -0.5, np.array([-0.7, -1.1, 0.9]))
    w = toxicity.words_of(["q w e r t y u"])
    e, n = field.emissions(w), 7
    into, back, stay = field.change
    p = np.zeros(n)
    total = 0.0
    for y in itertools.product((0, 1), repeat=n):
        s = sum(e[t] for t in range(n) if y[t]) + sum({(0, 0): 0, (0, 1): into, (1, 0): back, (1, 1): stay}[a, b] for a, b in zip((0, *y), y))
        total += np.exp(s)
        p += np.exp(s) * np.array(y)
    assert np.allclose(field.marginals(w, 1), p / total)


def test_toxicity_odd_rows_and_spans(odd, empty, spark):
    texts = ["good day to you all my friends"] * 60 + ["good day to grobnik you all my friends"] * 30
    model = toxicity.fit(texts, [0] * 60 + [1] * 30)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    scores, spans = model.score(["", "Good day Ä to GROBNIK you"])
    assert scores[0] < 0.7 and [(s, e) for s, e, _ in spans[1]] == [(14, 21)]
    assert toxicity.fit([], []).score(["x"])[0].tolist() == [0.0]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.judge(odd, labels).filter("predicted = 1").count() == 0


# URL filter


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "nourl"), (4, "http://WWW.Example.com/en/x?y"), (5, "http://blog.example.com/en/"), (6, "https://a.net/es/1#t"), (7, "http://b.org"), (8, "http://casino-win.example.org/x"), (9, "http://É.com/q://z"), (10, "http://x.com?/en/"), (10, "http://x.com?/en/")]
    frame = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "1 as score")
    got = {r.page_id: r for r in urls.judge(frame).collect()}
    for i, u in rows:
        assert (got[i].host, got[i].path) == urls.parts(u)
    assert (got[4].rule, got[4].verdict) == ("www.example.com/en/", "allow")
    assert (got[5].rule, got[5].verdict) == ("example.com/en/", "block")
    assert (got[6].rule, got[6].verdict) == ("net/es/", "block")
    assert got[7].rule is None and got[7].verdict == "allow" and got[8].verdict == "block" and got[10].rule is None
    assert got[1].verdict == "allow"
    assert urls.judge(frame.limit(0)).count() == 0
    bias, w = urls.train()
    for i, u in rows:
        g = urls.grams(*urls.parts(u))
        assert got[i].score == int(np.floor(bias * np.sqrt(max(len(g), 1)))) + sum(w[x] for x in g)


# SimHash


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd):
    got = simhash.digests(simhash.near_duplicates(odd)).collect()
    want = collections.Counter((r[0], f"{brute_fingerprint(r[1]):016x}") for r in ODD)
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == want
    assert {r.component_id for r in got if r.doc_id == 7} == {6}


@pytest.mark.parametrize("bucket_rows", [3, 4096])
def test_near_fingerprints(spark, bucket_rows):
    rng = random.Random(2)
    fps = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 25])):
            fps.append(f)
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(frame, 3, bucket_rows)).collect()}
    want = collections.defaultdict(set)
    for s, r in zip(signed, brute_components(fps)):
        want[r].add(s)
    got = collections.defaultdict(set)
    for s in signed:
        got[found.get(s, s)].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


# quality


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_base_figures(odd, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(odd).collect())
    assert got == collections.Counter((r[0], *brute_quality(r[1])) for r in ODD)
    assert quality.judge(empty).count() == 0


def test_quality_model_is_a_distribution_and_shards_agree(spark):
    rows = [(i, t, "en", "", 0) for i, t in enumerate(["abracadabra and more", "abba dab cab", "the cat sat on a mat", "babble"] * 3)]
    docs = spark.createDataFrame(rows, DOCS)
    table = quality.model_table(quality.counted(docs, "text"))
    (_, _, whole), = quality.shards(table)
    for context in ("\x01\x01\x01", "\x01\x01a", "abr", "zzz", "da "):
        k = 0
        for c in context:
            k = k << quality.SYMBOL_BITS | ord(c)
        keys = (k << quality.SYMBOL_BITS) | np.arange(quality.SYMBOLS)
        assert np.exp(whole.log_probabilities(keys & (1 << 48) - 1)).sum() == pytest.approx(1, abs=2e-3)
    one = {r.doc_id: r.log_perplexity for r in quality.judge(docs).collect()}
    many = {r.doc_id: r.log_perplexity for r in quality.judge(docs, shard_rows=40).collect()}
    assert one.keys() == many.keys() and all(one[i] == pytest.approx(many[i]) for i in one)


def test_quality_keeps_clean_and_drops_shouting(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id").quality
    known = got.join(labels, how="inner")
    clean = known[(known.quality == 1) & ~known.base_failed]
    assert clean.kept.mean() > 0.98
    assert not (got.kept & got.base_failed).any()
    assert known[known.quality == 0].kept.mean() < 0.25
    shouting = got[~got.base_failed & (got.n_symbols > got.n_words)]
    assert len(shouting) and not shouting.kept.any()


def test_quality_sees_word_order(spark):
    rng = np.random.default_rng(3)
    phrases = [[f"w{i}x{j}" for j in range(6)] for i in range(120)]
    text = lambda: [w for i in rng.permutation(120)[:40] for w in phrases[i]]
    salad = text()
    rng.shuffle(salad)
    rows = [(i, " ".join(text()), "en", "", 0) for i in range(60)] + [(99, " ".join(salad), "en", "", 0)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[99].base_failed and not got[99].kept
    assert sum(got[i].kept for i in range(60)) >= 58


def test_quality_code_points_share_no_symbol():
    one, other = (quality.grams([chr(c).encode()])[0].tolist() for c in (0x4E00, 0x4E00 + quality.SYMBOLS - 2))
    assert one != other
    assert len({tuple(quality.grams([chr(c).encode()])[0].tolist()) for c in range(2, 0x20000) if not 0xD800 <= c < 0xE000}) == 0x20000 - 2 - 0x800


# personal data


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_pii_base_equals_patterns():
    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choice("ab.@-+ 0123419%()x") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("4111 1111 1111 1111 and 4111111111111111") == [("card", 0, 19), ("card", 24, 40)]


def test_pii_labels_its_table_and_keeps_base():
    for text, spans in pii.parse():
        base, found = pii.find_all([text])[0]
        assert set(base) <= set(found) and sorted(found) == sorted(spans)


def test_pii_messages_are_exact_on_a_tree():
    import itertools

    rng = np.random.default_rng(1)
    unary, edges = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    pair = rng.normal(size=(3, 3, 3))
    p = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        s = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(pair[e, y[a], y[b]] for e, (a, b) in enumerate(edges)))
        p[range(4), y] += s
    assert np.allclose(pii.marginals(unary, edges, pair), p / p.sum(axis=1, keepdims=True), atol=1e-3)


def test_pii_repeats_share_a_label():
    text = "call 089-5550-4321 now . " + "word " * 40 + "and 089-5550-4321 again"
    spans = pii.find_all([text])[0][1]
    assert [text[s:e] for _, s, e in spans] == ["089-5550-4321"] * 2 and {k for k, _, _ in spans} == {"phone"}


def test_pii_odd_rows(odd, empty):
    assert pii.digests(pii.find(odd)).filter("spans = ''").count() == len(ODD)
    assert pii.find(empty).count() == 0
    assert pii.redact(odd).collect() == odd.collect()
    assert pii.replaced("a b@c.de f", [("email", 2, 8), ("phone", 4, 9)]) == "a [EMAIL]f"[:9] + "f"


# pages


def test_html():
    for page in ("", "<", "<p", "<!--", "</div>", "<script>x", "&amp;", "<p>a &lt; b"):
        html_text.main_text(page)
    assert [b.text for b in html_text.blocks("a < b <p>x &gt;\n y</p> 1<2<!-- c --> d<a title='x>y'>link</a>")] == ["a < b", "x > y", "1<2 dlink"]


def test_html_of_pages(spark):
    import html as H

    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet").selectExpr("*", "'t' as text")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")].replace("<br>", " ")
        want = [" ".join(H.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(x for x in want if x)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    assert [r.n_chars for r in html_text.digests(html_text.extract(odd)).collect()] == [0, 0, 0]


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        new = C.materialise(stage(spark, docs, SF), "test")
        assert new.columns == docs.columns and new.count() <= docs.count()
        if name == "simhash near-dedup":
            rows = docs.collect()
            roots = brute_components([brute_fingerprint(r.text) for r in rows])
            least = {}
            for r, k in zip(rows, roots):
                least[k] = min(least.get(k, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in new.collect()) == sorted(least.values())
        if name == "pii":
            assert not any(brute_spans(r.text) for r in new.collect())
        docs = new
    encode = library("byte_bpe_50k.json")
    check_pieces(C.STAGES[-1][1](spark, docs, SF).collect(), {r.doc_id: [*encode(r.text), 1] for r in docs.collect()})


def test_pipeline_empty(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(11)
    some = [f"word{i}" for i in range(60)]
    text = lambda: " ".join(rng.choice(some) for _ in range(90)) + "."
    good = [text() for _ in range(12)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(good[:8])] + [(None, good[8], "en", "a", 0), (None, "too short", "en", "a", 0), (3, "too short", "en", "a", 0), (3, good[9], None, "b", 0), (None, good[8], "en", "c", 0), (1, good[1], "en", "d", 0), (50, good[0] + "", "en", "e", 0), (9, None, "en", "f", 0)]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as root", "'x' as key_id", "2 as first")
    kept = quality.without_rejected(frame, allow=1e6)  # bands that a few documents can't leave
    assert kept.columns == frame.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter((r[0], r[1]) for r in rows if r[1] and len(r[1]) > 20)
    left = C.STAGES[2][1](spark, frame, SF)
    assert left.columns == frame.columns
    got = [(r.doc_id, r.text or "") for r in left.collect()]
    want = {(i, t) for i, t in enumerate(good[:8])} | {(None, good[8]), (3, "too short"), (3, good[9]), (9, "")}
    assert len(got) == len(want) and set(got) == want
