"""Operators of the training-data part against brute force, round trips and small edge cases."""

import functools
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from bindings.compare import checker, compare
from plumbline.llm import chat, chosen_path, curve_packing, decontaminate, hash_tree, metric_tree, page_model, queries, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, item_id int, label int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()
EDGES = [(1, None, 0, 0), (2, "", 0, 0), (3, " ".join(WORDS), 0, 0), (4, " ".join(WORDS), 0, 0), (4, " ".join(WORDS), 0, 0), (None, "one two", 0, 0), (5, "Ä ß " * 20_000, 0, 0)]


@pytest.fixture
def edges(table):
    return table(DOCS, *EDGES)


@pytest.fixture
def empty(table):
    return table(DOCS, (1, "x", 0, 0)).where("false")


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_sql(spark, name):
    result = compare(queries.QUERIES[name](spark, SF), checker(SF), queries.CHECKS[name])
    assert result["columns"] and result["same"], result


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_native_plans(spark):
    for name in ("op4_hash_tree_shards", "op9_decontamination"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_top_k_edges(table):
    rows = [(0, [1.0, 0.0], 9), (1, [1.0, 0.0], 9), (2, [1.0, 0.0], 9), (3, [float("nan"), 1.0], 9), (4, [None, 1.0], 9), (5, None, 9), (6, [-1.0, 0.5], 9), (0, [1.0, 0.0], 9), (None, [1.0, 1.0], 9)]
    df = table("vec_id long, embedding array<float>, score int", *rows)
    got = [tuple(r)[:4] for r in metric_tree.top_k(df, F.col("vec_id") == 0, k=10).sort("rank").collect()]
    assert got == [(0, 1, 1, 1 << 20), (0, 2, 2, 1 << 20), (0, 3, 6, -(1 << 20))]
    assert metric_tree.top_k(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_top_k_large_values(table):
    """Vectors of any size take part; where scores might not fit in 64 bits the call fails and leaves nothing out."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-400_000, 400_000, 5)]) for i in range(200)] + [(i, [float(v) for v in rng.integers(-9, 9, 5)]) for i in range(200, 300)]
    df = table("vec_id long, embedding array<double>", *rows)
    x = {i: [int(v) * 1024 for v in e] for i, e in rows}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in metric_tree.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    for own in range(0, 300, 50):
        wanted = sorted((-sum(a * b for a, b in zip(x[own], x[i])), i) for i in x if i != own)[:10]
        assert [got[own, k] for k in range(1, 11)] == [(i, -s) for s, i in wanted]
    for huge in ([131_071.0] * 300, [3e38]):
        with pytest.raises(ValueError, match="64 bits"):
            metric_tree.top_k(table("vec_id long, embedding array<double>", (0, [1.0]), (1, huge)), F.col("vec_id") == 0)


def test_top_k_tree(rng=np.random.default_rng(1)):
    x = rng.integers(-50, 50, (3000, 6))
    x[:500] = x[0]
    space = metric_tree.Space(6, int((x * x).sum(1).max()))
    pages = [(*p, p[2].astype(float)) for p in metric_tree.build_pages(np.arange(3000), x, space)]
    for own in (0, 700, 2999):
        best, compared = metric_tree.search(pages, x[own], own, 10, np.inf, space)
        wanted = sorted(((-int(s), i) for i, s in enumerate(x @ x[own]) if i != own))[:10]
        assert [(-s, i) for s, i in best] == wanted and compared < 3000


def test_packing(edges, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = curve_packing.pack(edges, path, length=64).collect()
    expected = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in EDGES)
    assert sum(r["length"] for r in rows) == sum(map(len, expected))
    ids = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(part) == r.length
        ids.setdefault(r.doc_id, []).extend(part) if r.doc_id != 4 else None
    assert all(ids[i] == tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in EDGES if i != 4)
    for sequence in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == sequence)
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
        size = sum(n for _, n in own)
        assert size & (size - 1) == 0 and size <= 64
    assert curve_packing.pack(empty, path).count() == 0


def test_hilbert_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = curve_packing.hilbert_key(cells, 3)
    walk = cells[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_near_classes(table, edges, empty):
    text = [f"w{i}" for i in range(200)]
    near, far = text[:150] + ["new"] + text[150:], text[:100] + [f"v{i}" for i in range(100)]
    df = table("doc_id long, text string, label int", (7, " ".join(text), 1), (3, " ".join(near).upper(), 1), (9, " ".join(far), 1), (8, "a b", 1), (6, "A  b", 1))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_classes(df).collect()}
    assert got == {7: (196, 3, False), 3: (197, 3, True), 9: (196, 9, True), 8: (1, 6, False), 6: (1, 6, True)}
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_classes(edges).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 15, 3, True), (4, 15, 3, False), (None, 1, None, True), (5, 2, 5, True)}
    assert chosen_path.near_classes(empty).count() == 0
    assert sorted(r.doc_id for r in chosen_path.one_of_each(df).collect()) == [3, 6, 9]


def test_near_dedup_rows(table):
    """An id with two texts is two documents, rows without id stay, and one of exact repeats stays."""
    text = [f"w{i}" for i in range(200)]
    copy, other = " ".join(text[:150] + ["new"] + text[150:]), " ".join(f"v{i}" for i in range(50))
    rows = [(3, " ".join(text), 1), (5, copy, 2), (5, other, 3), (None, "a b", 4), (None, "c d", 5), (7, "e f", 6), (7, "e f", 6), (9, other, 7), (9, other, 7)]
    got = sorted(r.label for r in chosen_path.one_of_each(table("doc_id long, text string, label int", *rows)).collect())
    assert got == [1, 3, 4, 5, 6]
    got = sorted(r.label for r in chosen_path.one_of_each(table("doc_id long, text string, label int", *rows[:2], *rows[3:6])).collect())
    assert got == [1, 4, 5, 6]


def test_large_nodes(table):
    rows = [(i, " ".join([f"w{j}" for j in range(100)] + [f"x{i}"])) for i in range(300)]
    got = chosen_path.near_classes(table("doc_id long, text string", *rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_common_passage(table, monkeypatch):
    """A passage that all share keeps nodes large, while only some documents are linked: blocks must meet completely."""
    monkeypatch.setattr(chosen_path, "BLOCK", 32)
    monkeypatch.setattr(chosen_path, "SMALL_NODE", 16)
    rng = np.random.default_rng(5)
    passage, rows = [f"w{j}" for j in range(60)], []
    for i in range(300):
        tail = [f"t{i // 2}_{j}" for j in range(12)] if i % 5 < 3 else [f"u{i}_{j}" for j in range(int(rng.integers(9, 15)))]
        rows.append((i, " ".join(passage + tail[:-1] + [f"x{i}"])))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    label = {i: i for i in sets}
    for b in sets:  # ids in order, so a label is always the smallest id reached so far
        for a in range(b):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    got = {r.doc_id: r.component_id for r in chosen_path.near_classes(table("doc_id long, text string", *rows)).collect()}
    assert got == label and 100 < len(set(label.values())) < 300


def test_shards(edges, empty):
    rows = hash_tree.place(edges, hash_tree.regular_tree(3), hash_tree.regular_tree(4)).collect()
    assert len(rows) == len(EDGES)
    assert {r.text_crc32 for r in rows if r.doc_id == 3} == {zlib.crc32(" ".join(WORDS).encode())}
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert hash_tree.place(empty, hash_tree.regular_tree(3)).count() == 0


def test_shards_move_only_into_new(spark):
    ids = spark.range(20_000).select("id", hash_tree.shard_of(F.col("id"), hash_tree.regular_tree(8)).alias("a"), hash_tree.shard_of(F.col("id"), hash_tree.regular_tree(9)).alias("b"))
    assert ids.where("a <> b AND b <> 8").count() == 0
    assert all(abs(r["count"] - 2500) < 300 for r in ids.groupBy("a").count().collect())


def test_warc_round_trip(spark, table):
    page = "<p>" + "é" * 600 + "WARC/1.1\r\n\r\n</p>"
    df = table("page_id long, url string, html string, payload int", (1, "http://a/\r\nx", page, 0), (2, None, page, 0), (3, "u", None, 0), (None, "u", "x", 0))
    rows = {r.page_id: r for r in warc.archived(df).collect()}
    assert (rows[1].record_type, rows[1].refers_to, rows[2].record_type) == ("revisit", 2, "response")
    assert rows[2].payload.decode() == page and rows[1].payload_bytes == rows[2].payload_bytes == len(page.encode())
    assert rows[3].payload_digest == hashlib.sha1(b"").hexdigest() and rows[None].payload == b"x"
    assert warc.archived(df.where("false")).count() == 0


def test_warc_salvage(table):
    df = table("page_id long, url string, html string", *[(i, "u", f"<p>page {i}</p>") for i in range(5)])
    records = [r.value.encode() + b"\n" for r in warc.records(df).sort("value").collect()]
    data = b"".join(records)
    bad = data[: len(records[0]) + 40] + b"\0" * 7 + data[len(records[0]) + 40 :]
    found = list(warc.salvage(b"junk" + bad + records[0][:50]))
    assert sum(f[1] for f in found) == len(bad) + 54 and len([f for f in found if f[2]]) == 4 and len([f for f in found if f[4]]) == 3
    pack = [zlib.compress(r, wbits=31) for r in records]
    broken = pack[0] + pack[1][:-9] + pack[2] + b"\x1f\x8b\x08\0" + pack[3]
    found = list(warc.salvage(broken))
    assert [bool(f[2]) for f in found] == [True, False, True, False, True] and sum(f[1] for f in found) == len(broken)


def test_warc_salvage_any_start(table, monkeypatch):
    """Later members are read whatever the archive begins with, and all records of a member."""
    rows = [(i, "u", f"<p>page {i}</p>") for i in range(5)]
    records = [r.value.encode() + b"\n" for r in warc.records(table("page_id long, url string, html string", *rows)).sort("value").collect()]
    pack = [zlib.compress(r, wbits=31) for r in records]
    for data, kinds in (
        (b"\0" + pack[0][1:] + b"".join(pack[1:]), [0, 1, 1, 1, 1]),
        (b"junk" + b"".join(pack), [0, 1, 1, 1, 1, 1]),
        (zlib.compress(b"".join(records), wbits=31), [1] * 5),
        (zlib.compress(b"".join(records[:2]) + b"junk" + records[2], wbits=31) + pack[3], [1, 1, 0, 1, 1]),
        (b"".join(pack[:2]) + records[2] + pack[3], [1] * 4),
        (zlib.compress(b"".join(records), wbits=31)[:-9], [1] * 4 + [0]),
    ):
        found = list(warc.salvage(data))
        assert [int(bool(f[2])) for f in found] == kinds and sum(f[1] for f in found) == len(data)


def test_warc_files_and_gaps(spark, table, tmp_path, monkeypatch):
    """Files are bounded by bytes, and the query fails on a gap or a missing page."""
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 10)
    rows = [(i, "u", f"{i}" + "x" * (9_000 if i % 2 else 10)) for i in range(40)]
    warc.write_archives(table("page_id long, url string, html string", *rows).coalesce(1), str(tmp_path / "w"))
    assert max(f.stat().st_size for f in (tmp_path / "w").glob("part-*")) <= 40_000
    assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == list(range(40))
    whole = warc.archived(spark.read.parquet(f"{SF}/pages.parquet"), payloads=False)
    for broken in (whole.where("page_id <> 3"), whole.withColumn("gap", F.when(F.col("page_id") == 3, "version line"))):
        monkeypatch.setattr(warc, "archived", lambda pages, payloads, broken=broken: broken)
        with pytest.raises(RuntimeError):
            queries.op5_warc_salvage(spark, SF)


def test_page_model(table):
    model = page_model.trained_model()
    forest = page_model.Forest()
    for i, page in enumerate(page_model.labelled_pages(150, seed=99)):
        page_model.parse(forest, i, page, page_model._label)
    chance, joint = page_model.Graph(forest).marginals(model)
    text = np.array(forest.kind) == 1
    assert ((chance >= 0.5) == np.array(forest.label))[text].mean() > 0.97
    inner = np.array(forest.parent) >= 0
    assert np.allclose(joint[inner].sum(1)[:, 1], chance[inner])
    html = "<body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>Some  text\nhere.<script>x</script><p>More text.</article><footer>&copy; x</footer>"
    df = table("page_id long, url string, html string, text int", (1, "u", html, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "<div>" * 5000, 0))
    got = {r.page_id: (r.text, r.n_chars) for r in page_model.extract(df, model).collect()}
    assert got[1] == ("A & B Some text here. More text.", 32) and got[2] == got[3] == got[4] == ("", 0)
    assert page_model.extract(df.where("false"), model).count() == 0


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<p>One <svg class=i/> two</p><p>Three.</p>", ["One two", "Three."]),
        ("<p>One <svg class=i /> two</p><article>All</article><svg><text>no</text></svg><p>Three.", ["One two", "All", "Three."]),
        ("<p>One <svg> two</p><article>All</article><svg><svg><text>no</text></svg>no</svg><p>Three.", ["One two", "All", "Three."]),
        ("<button>x<p>b</p>", ["x", "b"]),
        ("<button>no<p>no</p></button><object><select><p>b</p>", ["b"]),
        ("<head><title>t</title><article><p>All of it", ["All of it"]),
        ("<head><title>t<meta charset=x><article><p>All of it", ["All of it"]),
        ("<head><script>'<body>'</script><style>p{}</style></head><body>All", ["All"]),
        ("<p>a</p><script>no <p>no</p>", ["a"]),
        ("<p>a</p><textarea>no <p>no</p>", ["a"]),
        ("<noscript><p>no</p><!-- </noscript> --><p>no</p></noscript><template><script></template></script>no</template><p>b", ["b"]),
        ("<button>" * 20_000 + "<p>b", ["b"]),
    ],
)
def test_page_unseen(html, wanted):
    forest = page_model.Forest()
    page_model.parse(forest, 0, html)
    assert [t for t, kind in zip(forest.text, forest.kind) if kind == 1] == wanted


def test_toxicity(edges, empty, table):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 40)) + (f" {rng.choice(['horrible', 'nastyone'])} end" if i % 4 == 0 else "") for i in range(400)]
    df = table("doc_id long, text string", *enumerate(texts))
    labels = table("doc_id long, toxic int, text string", *[(i, int(i % 4 == 0), "") for i in range(400)], (None, 1, ""), (5, None, ""))
    model = toxicity.fit(df, labels)
    probe = table("doc_id long, text string", (0, texts[1] + " horible"), (1, texts[1]), (2, texts[2] + " horrible"))
    score = {r.doc_id: r.score for r in toxicity.scores(probe, model).collect()}
    assert score[2] > 0.7 and score[0] > score[1] and score[1] < 0.3
    assert toxicity.scores(edges, model).where("score BETWEEN 0 AND 1").count() == len(EDGES)
    assert toxicity.scores(empty, model).count() == 0 and toxicity.fit(empty, labels).table.max() == 0
    assert [r.doc_id for r in toxicity.without_toxic(probe.withColumn("extra", F.lit(1)), model).where("doc_id > 0").collect()] == [1]


def test_toxic_words_are_picked_per_text():
    """The bag of a text against sorting its words one text at a time, with ties, empty and short texts."""
    rng = np.random.default_rng(3)
    by_word = rng.integers(-3, 4, 30).astype(float)
    texts = [rng.integers(0, 30, n) for n in (0, 1, 3, 4, 5, 0, 200, 0)]
    offsets, codes = np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.concatenate(texts)
    word, text = toxicity.most_toxic(by_word, offsets, codes, toxicity.first_of_each(offsets, 4))
    for i, own in enumerate(texts):
        wanted = sorted(own, key=lambda c: (-by_word[c], c))[:4]
        assert list(word[text == i]) == wanted
    none = np.zeros(0, dtype=np.int64)
    word, text = toxicity.most_toxic(np.zeros(0), np.array([0, 0]), none, toxicity.first_of_each(np.array([0, 0]), 4))
    assert len(word) == len(text) == 0


def test_toxicity_of_words_that_come_again(table):
    """A word that clean texts hold once and toxic ones three times: held-out texts are told apart by the count."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}o" for a in "bcdfghjklm" for b in ("an", "el", "ir", "os", "ut")]
    def text(times):
        body = list(rng.choice(words, 60))
        for i in range(times):
            body.insert(7 + 11 * i, "grumwick" + str(rng.choice(["s", "er", "ing"])))
        return " ".join(body)
    rows = [(i, text(3 if i % 8 == 0 else int(i % 8 == 1))) for i in range(1200)]
    labels = table("doc_id long, toxic int", *[(i, int(i % 8 == 0)) for i in range(800)])
    df = table("doc_id long, text string", *rows)
    score = {r.doc_id: r.score for r in toxicity.scores(df, toxicity.fit(df, labels)).collect()}
    held = range(800, 1200)
    assert np.mean([score[i] >= 0.7 for i in held if i % 8 == 0]) > 0.9
    assert np.mean([score[i] >= 0.7 for i in held if i % 8]) < 0.02


def test_toxicity_trains_rare_words(table):
    """All 4,000 rows a model may take are learned from, and so is a word that few of them hold."""
    assert toxicity.MAX_TRAIN == 4000
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 12)) + (f" zq{chr(97 + i % 20)}{chr(97 + i // 20 % 20)}xj" if i < 40 else "") for i in range(800)]
    rows = table("doc_id long, text string", *enumerate(texts))
    model = toxicity.fit(rows, table("doc_id long, toxic int", *[(i, int(i < 40)) for i in range(800)]))
    assert model.table[toxicity.subwords(["zqaaxj"])[0]].all()
    score = np.array([r.score for r in toxicity.scores(rows, model).sort("doc_id").collect()])
    assert (score[:40] > 0.5).all() and (score[40:] < 0.5).all()


def test_token_counts(edges, empty):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -3.0, "▁a": -2.5, "ba": -3.5}

    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            best.append(max([(best[i - 1][0] + token_counts.BYTE_SCORE * size, best[i - 1][1] - size)] + [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in scores]))
        return -best[-1][1]

    trie = token_counts.Trie(scores)
    words = ["▁" + w for w in ("ab", "abba", "aba", "b", "aßb", "a" * 50)]
    assert [trie.count(w) for w in words] == [brute(w) for w in words]
    got = {(r.doc_id, r.n_pretokens) for r in token_counts.count_tokens(edges, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got == {(1, 0), (2, 0), (3, 19), (4, 19), (None, 2), (5, 40_000)}
    assert token_counts.count_tokens(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_token_counts_real_texts(spark):
    """``n_tokens`` of real texts against the recurrence word by word, without a trie; the file's scores are ranks."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.piece_scores(path)
    longest = max(map(len, scores))
    assert sorted(scores.values(), reverse=True)[:3] == [-2.0, -3.0, -4.0]

    @functools.cache
    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            ways = [(best[i - 1][0] + token_counts.BYTE_SCORE * size, best[i - 1][1] - size)]
            ways += [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if word[j:i] in scores]
            best.append(max(ways))
        return -best[-1][1]

    texts = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(texts, path).collect()}
    assert got == {r.doc_id: sum(brute("▁" + w) for w in re.split("[ \t-\r]+", r.text or "") if w) for r in texts.collect()}


def test_decontamination_edges(edges, empty, table):
    bench = table("item_id long, text string, doc_id int", (1, " ".join(WORDS[3:14]).upper(), 0), (2, "one, TWO!", 0), (3, None, 0), (4, "...", 0), (None, "ä ß", 0))
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.find_passages(edges, bench).collect()}
    assert got == {(1, 0, 0, ()), (2, 0, 0, ()), (3, 19, 11, ("1",)), (4, 19, 11, ("1",)), (None, 2, 2, ("2",)), (5, 40_000, 0, ())}
    assert decontaminate.find_passages(edges, bench).count() == len(EDGES)
    assert decontaminate.find_passages(empty, bench).count() == 0
    assert decontaminate.find_passages(edges, bench.where("false")).where("n_hit = 0").count() == len(EDGES)
    assert sorted(r.doc_id for r in decontaminate.clean_documents(edges, bench).collect()) == [1, 2, 5]


def test_decontamination_rows(table):
    """A contaminated row takes no other row along, with or without an id."""
    leak = " ".join(WORDS)
    rows = [(None, leak, 1), (None, "clean", 2), (5, leak, 3), (5, "clean too", 4), (None, None, 5), (6, leak, 6), (6, leak, 6)]
    bench = table("item_id long, text string", (1, " ".join(WORDS[3:14])))
    clean = decontaminate.clean_documents(table("doc_id long, text string, label int", *rows), bench)
    assert sorted(r.label for r in clean.collect()) == [2, 4, 5]


def test_chat(table):
    texts = ["<s>\\</s>[INST]\n<|im_start|>\\<|im_end|>", "", "a\\n\\\\", "<|im_end", None]
    for role in ("user", "a\nb", "</s>", "\\"):
        for text in texts[:4]:
            formatted, start, length = chat.render_turn(role, text)
            assert chat.read_turn(formatted) == (role, text)
            assert not any(m in chat.escape(text) for m in chat.CONTROL) and chat.unescape(chat.escape(text)) == text
    df = table("conv_id long, turn long, role string, text string, seq int", *[(c, i, r, t, 0) for c in (1, None) for i, t in enumerate(texts) for r in ("assistant", "user")], (2, None, None, None, 0))
    turns = chat.fold_and_render(chat.events_of(df, piece=3))
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    body = "".join(f"{r}\n{t or ''}\n" for t in texts for r in ("assistant", "user"))
    assert got[1].turns_sha256 == got[None].turns_sha256 == hashlib.sha256(body.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(t or "" for t in texts).encode()).hexdigest()
    assert (got[1].n_turns, got[2].n_turns) == (10, 1)
    assert chat.digests(chat.fold_and_render(chat.events_of(df.where("false")))).count() == 0


def test_pipeline(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        kept[name] = {r.doc_id for r in after.select("doc_id").collect()}
        before = spark.createDataFrame(after.collect(), docs.schema)
    packed = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert packed == kept["decontamination"] <= kept["near_dedup"] <= kept["toxicity"] and packed


def test_unclosed_tags_take_time_in_proportion():
    def seconds(text):
        begun = time.monotonic()
        page_model.parse(page_model.Forest(), 0, text)
        return time.monotonic() - begun

    for part in ("<a ", "<script><body>", '<a ">" ', "<script ", "<!", "<div><li></li>", "<p><svg>"):
        few, many = part * (100_000 // len(part)), part * (1_000_000 // len(part))
        assert seconds(many) < 30 * max(seconds(few), 0.05), part


def test_deep_menu_is_no_content(table):
    deep = "<div>" * 250
    html = f"<html><body><article><h1>News of the day</h1><p>{' '.join(WORDS)}. {' '.join(WORDS[::-1])}.</p></article>{deep}<nav class=menu><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul></nav>{'</div>' * 250}</body></html>"
    row = page_model.extract(table("page_id long, url string, html string", (1, "u", html)), page_model.trained_model()).first()
    assert "alpha beta" in row.text and "Home" not in row.text


def test_long_text_with_passage(table):
    passage = " ".join(f"k{i}" for i in range(12))
    long = " ".join(f"w{i % 9973}" for i in range(1_000_000))
    bench = table("item_id string, text string", ("a", passage), ("b", "one two three"))
    got = decontaminate.find_passages(table("doc_id long, text string", (1, f"{long} {passage}"), (2, "x one two three")), bench)
    assert sorted(tuple(r)[:5] for r in got.collect()) == [(1, 1_000_012, 12, 1, ["a"]), (2, 4, 3, 1, ["b"])]


def test_stages_with_clashing_names(table):
    names = ["_id", "_toxic", "_hit", "_dropped", "_again", "_row", "row", "hit", "dropped", "ROW"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[:-1])
    text = " ".join(WORDS)
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (None, text), (5, "other words of a text that is clean")]
    df = table(schema, *[(*r, *range(len(names) - 1)) for r in rows])
    bench = table("item_id string, text string, hit int", ("a", " ".join(WORDS[:12]), 0))
    assert sorted(r.doc_id for r in decontaminate.clean_documents(df, bench).collect()) == [3, 4, 5]
    kept = chosen_path.one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5]
    for stage in (lambda d: decontaminate.clean_documents(d, bench), chosen_path.one_of_each):
        assert stage(df.where("false")).count() == 0
    labels = table("doc_id long, toxic int", (1, 1), (5, 0))
    model = toxicity.fit(df, labels)
    assert toxicity.without_toxic(df.where("false"), model).count() == 0


def test_words_are_read_faster_than_value_by_value():
    """Distinct words of a chunk become Python texts through one array."""
    import pyarrow as pa

    from plumbline.llm.common import split_words

    texts = pa.array([" ".join(f"word{i}" for i in range(200_000)), None, " wörd  word1\t"])
    offsets, codes, words = split_words(texts)
    assert offsets.tolist() == [0, 200_000, 200_000, 200_002]
    assert [words[c] for c in codes[-3:]] == ["word199999", "wörd", "word1"]

    def seconds(function):
        took = []
        for _ in range(3):
            start = time.process_time()
            function()
            took.append(time.process_time() - start)
        return min(took)

    distinct = pa.array(words)
    assert seconds(lambda: split_words(texts)) < seconds(distinct.to_pylist)
