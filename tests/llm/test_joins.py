"""Hard negatives, the prefix trie and the grouped prefix join against brute force and on edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import group_prefix, hard_negatives, prefix_trie

CLASH = "g int, a int, r int, node int, label2 int, _slice int, number int, group int"
CLASHING = (0,) * 8


# Hard negatives


def mined(rows, anchor=lambda v: v % 3 == 0):
    rows = [(v, y, np.floor(256 * np.array(x))) for v, x, y, *_ in rows if None not in (v, x, y) and None not in x and np.isfinite(x).all()]
    out = []
    for v, y, x in rows:
        if not anchor(v):
            continue
        others = sorted(((-int(x @ z), w, k) for w, k, z in rows if w != v))
        for s, p, _ in [o for o in others if o[2] == y][:5]:
            good = [o for o in others if o[2] != y and 80 * -s <= 100 * -o[0] <= 100 * -s]
            out += [(v, p, i + 1, w, -s, -t) for i, (t, w, _) in enumerate(good[:5])]
    return sorted(out)


def test_hard_negatives(table, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_COMPONENTS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHOR_COMPONENTS", 32)
    random.seed(5)
    rows = [(i, [random.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], random.choice([0, 0, 0, 1, 2]), *CLASHING) for i in range(60)]
    rows += [(70, None, 1, *CLASHING), (72, [float("nan")] * 4, 1, *CLASHING), (75, [None, 1.0, 1.0, 1.0], 0, *CLASHING), (78, [1.0] * 4, None, *CLASHING), (None, [1.0] * 4, 0, *CLASHING), (6, [1.0] * 4, 0, *CLASHING), (6, [1.0] * 4, 0, *CLASHING)]
    df = table("vec_id long, embedding array<float>, label int, " + CLASH, *rows)
    got = hard_negatives.mine(df, F.col("vec_id") % 3 == 0)
    want = mined(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50
    for none in (df.where("false"), df.where("vec_id = 3")):
        assert hard_negatives.mine(none, F.col("vec_id") % 3 == 0).count() == 0


def test_hard_negatives_of_equal_rows(table):
    rows = [(i, [1.0, 0.0], int(i >= 40)) for i in range(80)]
    df = table("vec_id long, embedding array<float>, label int", *rows)
    assert sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") == 0).collect()) == mined(rows, lambda v: v == 0)


def test_hard_negatives_of_large_values(table):
    rows = [(0, [1e5, 3.0], 0), (1, [1e5, 1.0], 0), (2, [1e5, 0.0], 1), (3, [-1e5, 0.0], 1)]
    df = table("vec_id long, embedding array<double>, label int", *rows)
    assert sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") == 0).collect()) == mined(rows, lambda v: v == 0)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.mine(table("vec_id long, embedding array<double>, label int", (0, [1e9], 0)), F.col("vec_id") == 0)


# Prefix trie


def tries(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if conv is not None:
            own[conv].append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    out = []
    for k, members in nodes.items():
        below = {q: m for q, m in nodes.items() if q[: len(k)] == k}
        leaves = sum(not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in nodes) for q in below)
        saved = sum((len(m) - 1) * len(q[-1][1].split()) for q, m in below.items() if q)
        ends = ",".join(map(str, sorted(c for c in members if rebuilt[c] == k)))
        out.append((
            min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members),
            sum(len(q) == len(k) + 1 for q in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest(), *(k[-1] if k else (None, None)),
        ))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, " + CLASH


@pytest.mark.parametrize("piece", [3, 4096])
def test_trie(table, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "SLICE", piece)
    random.seed(9)
    rows = []
    for c in [*range(0, 45), 60, 62, 79]:
        for t in range(random.randint(1, 6)):
            rows.append((c, t, random.choice(["user", "assistant"]), random.choice(["a b", "a b", " c\td ", "Ä ß"]), *CLASHING))
    rows += [(41, t, "user", "long one", *CLASHING) for t in range(20, 40)]
    rows += [(3, None, None, None, *CLASHING), (3, None, "user", "", *CLASHING), (7, 1, "user", "tie", *CLASHING), (7, 1, "user", "tie", *CLASHING), (7, 1, "user", None, *CLASHING), (None, 1, "user", "x", *CLASHING)]
    got = prefix_trie.trie(table(TURNS, *rows), with_texts=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == tries(rows)


def test_trie_without_rows(table):
    assert prefix_trie.trie(table(TURNS, (1, 1, "user", "x", *CLASHING)).where("false")).count() == 0


def test_trie_of_turnless(table):
    rows = [(c, 0, "user", "only") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1]
    got = prefix_trie.trie(table("conv_id long, turn long, role string, text string", *rows)).collect()
    assert [(r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [(0, len(rows), 0, 1, 0)]


# Grouped prefix join


def classes(rows, percent=80):
    def words(text):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")

    sets = []
    for doc, text, *_ in rows:
        w = [x for x in words(text) if x]
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted([find(a), find(b)])
                root[q] = p
    return sorted(((d, len(x), None if d is None else find(d) if x else d) for d, x in sets), key=repr)


DOCS = "doc_id long, text string, " + CLASH


def edited(words, share):
    return [random.choice("abcdefgh") + str(random.randint(0, 99)) if random.random() < share else w for w in words]


@pytest.mark.parametrize("small", [False, True])
def test_grouped_prefix_join(table, monkeypatch, small):
    if small:
        monkeypatch.setattr(group_prefix, "GROUP", 3)
        monkeypatch.setattr(group_prefix, "BLOCK", 2)
        monkeypatch.setattr(group_prefix, "MOST_FREQUENT", 7)
        monkeypatch.setattr(group_prefix, "SLICE_BYTES", 16)
    random.seed(11)
    passage = [f"common{i}" for i in range(30)]
    rows = []
    for family in range(12):
        base = [f"w{family}x{random.randint(0, 400)}" for _ in range(random.choice([5, 9, 40, 160]))]
        for _ in range(random.choice([1, 3, 9])):
            rows.append(" ".join(edited(base, random.choice([0, 0.005, 0.01, 0.02]))))
    rows += [" ".join(passage + [f"own{k}y{i}" for i in range(random.randint(0, 9))]) for k in range(40)]
    rows += [" ".join(passage)] * 4 + ["one", "ONE", "two words", "", None, "Ä ß " * 2000, "ä ß " * 2000]
    # One prefix and size, many members: chains that differ in a few late words
    rows += [" ".join(passage * 3 + [f"tail{i}" for i in range(k % 3, 20)] + [f"end{k}"]) for k in range(30)]
    rows = [(i, t, *CLASHING) for i, t in enumerate(rows)]
    rows += [(None, "two words", *CLASHING), (None, None, *CLASHING), rows[0], rows[0]]
    df = table(DOCS, *rows)
    got = group_prefix.similar_classes(df)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == classes(rows)
    assert group_prefix.similar_classes(df.where("false")).count() == 0


def test_texts_of_one_id_are_linked(table):
    a, b = "a b c d e f g", "h i j k l m n"
    df = table("doc_id long, text string", (5, a), (5, b), (6, a), (4, b), (5, None), (9, "x"))
    got = sorted(tuple(r) for r in group_prefix.similar_classes(df).collect())
    assert got == [(4, 3, 4), (5, 0, 5), (5, 3, 4), (5, 3, 4), (6, 3, 4), (9, 1, 9)]
