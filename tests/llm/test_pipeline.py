"""The pipeline against each of its stages written again in plain Python, on documents with planted cases."""

import math
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def toxic_score(model, text):
    found = words((text or "").lower())
    runs = [w for i, w in enumerate(found) if i == 0 or w != found[i - 1]]
    chance = [model.table[toxicity.subwords([w])[0]].mean(dtype=float) for w in runs]
    return 1 / (1 + math.exp(-(sum(sorted(chance)[-4:]) / 4 + model.bias)))


def shingles(text):
    w = words(ascii_lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def one_of_each(docs):
    """Distinct rows with an id in order, one per component of the pairs of all rows; rows without an id stay."""
    known = sorted({d for d in docs if d[0] is not None}, key=lambda d: (d[0], d[1] or ""))
    sets, leader = [shingles(d[1]) for d in known], list(range(len(known)))

    def find(i):
        return i if leader[i] == i else find(leader[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = find(i), find(j)
                leader[max(x, y)] = min(x, y)
    return [d for i, d in enumerate(known) if leader[i] == i] + [d for d in docs if d[0] is None]


def passage_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text))


def clean(docs, items):
    windows = set()
    for item in items:
        w = passage_words(item)
        windows |= {" " + " ".join(w[i : i + 10]) + " " for i in range(max(len(w) - 9, 1))} if w else set()
    bodies = [" " + " ".join(passage_words(d[1])) + " " for d in docs]
    return [d for d, body in zip(docs, bodies) if not any(w in body for w in windows)]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Given documents, and copies, passages, toxic texts, repeated ids and rows without text or id among them."""
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in labels.where("toxic = 1").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    by_length = sorted((d for d in given if d[0] not in bad and d[1]), key=lambda d: -len(words(d[1])))
    near = words(by_length[0][1])
    near[len(near) // 2] = "anotherword"
    toxic = next(d[1] for d in given if d[0] in bad)
    long_item = max(items, key=lambda t: len(passage_words(t)))
    lone = [" ".join(f"lone{n}x{i}" for i in range(30 + 7 * n)) for n in range(5)]
    texts = [
        (9001, by_length[1][1]), (9002, by_length[1][1].upper()), (9003, " ".join(near)), (9004, lone[0] + " " + long_item),
        (9005, toxic), (9006, "Before. " + toxic + " After."), (9007, None), (9008, ""), (None, lone[1]), (None, by_length[1][1]),
        (9009, lone[2]), (9009, lone[3]), (9009, lone[3]), (9010, lone[4] + " end"), (9011, lone[4] + " end"),
    ]
    rows = given + [(i, t, "en", "planted", None if t is None else len(t)) for i, t in texts]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder, rows, items


def test_stages_equal_plain_python(spark, planted):
    folder, rows, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.toxicity_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = {d: toxic_score(model, d[1]) for d in set(rows)}
    assert all(abs(s - queries.TOXIC_FROM) > 1e-6 for s in score.values())
    wanted = [[d for d in rows if score[d] < queries.TOXIC_FROM]]
    wanted.append(one_of_each(wanted[0]))
    wanted.append(clean(wanted[1], items))
    before = rows
    for (name, stage), after in zip(corpus_pipeline.STAGES, wanted):
        got = stage(spark, spark.createDataFrame(before, SCHEMA), folder)
        assert got.columns == docs.columns, name
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, after)), name
        assert 0 < len(after) < len(before), name
        before = after
    kept = {d[0] for d in wanted[2]}
    assert not kept & {9001, 9002, 9003, 9004, 9011} and {None, 9007, 9008, 9009, 9010} <= kept
    assert sum(d[0] is None for d in wanted[2]) == 2 and sum(d[0] == 9009 for d in wanted[2]) == 2

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(d[0], [*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 2]) for d in wanted[2]]
    pieces = corpus_pipeline.run(spark, folder).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        parts[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    found = [(key[0], sum((p for _, p in sorted(part)), [])) for key, part in parts.items()]
    assert sorted(map(repr, found)) == sorted(map(repr, ids))
    for part in sequences.values():
        offset = 0
        for at, length in sorted(part):
            assert at == offset and length > 0
            offset += length
        assert offset <= 4096 and offset & (offset - 1) == 0  # nothing is padded


def test_pipeline_of_nothing(spark, planted):
    folder, rows, items = planted
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
