import hashlib
import time
import random

import numpy as np
import pytest

from plumbline.functions import wanted
from plumbline.functions.hunks import changed_ranges, diff_hash
from plumbline.operators import branches, history, similarity, trees
from plumbline.constants import DIRECT
from plumbline.session import shuffles_freed
from tests.conftest import rows

DIFF = "repo string, discrepancy string, path string, code string, left_hash string, right_hash string, raw_change_type string"
BLOBS = "repo string, blob string, text string"
L = [f"line {i}" for i in range(20)]


def text(*lines):
    return "\n".join(lines)


def deleted(path, blob, d="x"):
    return ("r", d, path, "D", blob, None, "D")


def added(path, blob, d="x"):
    return ("r", d, path, "A", None, blob, "A")


def kinds(df):
    return sorted((r.path, r.raw_change_type, r.old_path) for r in df.collect())


def test_best_pairs_first(table):
    blobs = table(
        BLOBS, ("r", "a", text(*L)), ("r", "b", text(*L[:15], *"12345")), ("r", "n1", text(*L[:19], "z")), ("r", "n2", text(*L[:14], *"uvwxyz")),
        ("r", "half", text(*L[:10], *"abcdefghij")), ("r", "less", text(*L[:9], *"ABCDEFGHIJK")), ("r", "none", None), ("q", "n1", text(*L)),
    )
    diff = table(DIFF, deleted("d/a", "a"), deleted("d/b", "b"), deleted("d/none", "none"), added("n/1", "n1"), added("n/2", "n2"), added("n/unknown", "missing"))
    # a and n1 share 19 of 20, then b takes n2 with 14
    want = [("d/none", "D", None), ("n/1", "R095", "d/a"), ("n/2", "R070", "d/b"), ("n/unknown", "A", None)]
    assert kinds(similarity.with_similar(diff, blobs)) == want
    edge = table(DIFF, deleted("d/a", "a"), added("n/half", "half"), added("n/less", "less"))
    assert kinds(similarity.with_similar(edge, blobs)) == [("n/half", "R050", "d/a"), ("n/less", "A", None)]
    assert similarity.with_similar(diff.where("false"), blobs).count() == 0


def test_equal_contents_are_served_in_path_order(table):
    blobs = table(BLOBS, ("r", "a", text(*L)), ("r", "b", text(*L[:18], "u", "v")), ("r", "c", text(*L[:16], *"wxyz")))
    diff = table(DIFF, *[deleted(f"d/{i}", "a") for i in range(3)], *[added(f"n/b{i}", "b") for i in range(2)], *[added(f"n/c{i}", "c") for i in range(2)])
    want = [("n/b0", "R090", "d/0"), ("n/b1", "R090", "d/1"), ("n/c0", "R080", "d/2"), ("n/c1", "A", None)]
    assert kinds(similarity.with_similar(diff, blobs)) == want


def test_line_ends_and_repeated_lines(table):
    blobs = table(BLOBS, ("r", "lf", text(*L)), ("r", "crlf", "\r\n".join(L)), ("r", "many", text(*["x"] * 10)), ("r", "few", text(*["x"] * 6, *"abcd")))
    diff = table(DIFF, deleted("d/lf", "lf"), added("n/crlf", "crlf"), deleted("d/many", "many"), added("n/few", "few"))
    assert kinds(similarity.with_similar(diff, blobs)) == [("n/crlf", "R099", "d/lf"), ("n/few", "R060", "d/many")]


def test_copies_of_modified_files(table):
    blobs = table(BLOBS, ("r", "old", text(*L)), ("r", "new", text(*L[:18])), ("r", "c", text(*L[:19], "z")))
    diff = table(DIFF, ("r", "x", "m", "M", "old", "new", "M"), added("n/1", "c"), added("n/2", "c"))
    assert kinds(similarity.with_similar(diff, blobs, copies=True)) == [("m", "M", None), ("n/1", "C095", "m"), ("n/2", "C095", "m")]
    assert [k for _, k, _ in kinds(similarity.with_similar(diff, blobs))] == ["M", "A", "A"]


def test_no_pair_beyond_shared_rare_lines(table, monkeypatch):
    seen = []
    cut = similarity.cut_lineage
    monkeypatch.setattr(similarity, "cut_lineage", lambda df, label="step": seen.append((label, out := cut(df, label))) or out)
    licence = [f"licence {i}" for i in range(8)]
    blobs = table(BLOBS, *[("r", f"{s}{i}", text(*licence, *[f"{s}{i} own {k}" for k in range(12)])) for i in range(40) for s in "ln"])
    diff = table(DIFF, *[deleted(f"d/{i}", f"l{i}") for i in range(40)], *[added(f"n/{i}", f"n{i}") for i in range(40)])
    assert {k for _, k, _ in kinds(similarity.with_similar(diff, blobs))} == {"A", "D"}
    assert [df.count() for label, df in seen if label == "asked"] == [0]


def test_pairs_no_direction_asks_for_are_not_met(table, monkeypatch):
    """Left and right contents of different directions, and files too short behind their first shared line, are no candidates."""
    seen = []
    cut = similarity.cut_lineage
    monkeypatch.setattr(similarity, "cut_lineage", lambda df, label="step": seen.append((label, out := cut(df, label))) or out)
    blobs = table(BLOBS, *[("r", f"{s}{i}", text(*L[:19], f"{s}{i}")) for i in range(12) for s in "ln"], ("r", "long", text(*L, *[f"own {k}" for k in range(18)])))
    diff = table(DIFF, *[row for i in range(12) for row in (deleted(f"d/{i}", f"l{i}", f"x{i}"), added(f"n/{i}", f"n{i}", f"x{i}"))], added("n/long", "long", "x0"))
    assert {k for _, k, _ in kinds(similarity.with_similar(diff, blobs, copies=True))} == {"R095", "A"}
    asked = [df for label, df in seen if label == "asked"][0]
    assert sorted((r.left, r.right, r.asked_in) for r in asked.collect() if r.right != "long") == sorted((f"l{i}", f"n{i}", [f"x{i}"]) for i in range(12))
    assert len([1 for label, _ in seen if label == "all_lines"]) == 1


# Folder hashes

FILES = "repo string, tree string, path string, blob_hash string"


def test_stored_diff_equals_tree_diff(spark, table, tmp_path):
    random.seed(3)
    names = [f"{a}/{b}/{c}" for a in "ab" for b in ("m", "n/o", "n") for c in ("x", "y", "z")] + ["top", "a//odd", "a/m/x/deep", "b/slash/"]
    files = [(r, b, p, random.choice("123")) for r in ("r", "s") for b in ("master", "test", "production") for p in names if random.random() < 0.8]
    files += [("only", "test", "p/q", "1"), ("r", "master", "nohash", None)]
    trees.store_trees(table(FILES, *files), str(tmp_path), 4)
    stored = trees.read_trees(spark, str(tmp_path))
    repos = table("repo string", ("r",), ("s",), ("only",), ("empty",))
    got = trees.stored_diff(stored, trees.tree_pairs(repos, DIRECT), 4)
    wide = branches.wide_files(table("repo string, branch string, path string, blob_hash string", *files))
    want = branches.tree_diff(wide, DIRECT)
    assert rows(got.select(*want.columns)) == rows(want) and want.count() > 50
    assert trees.missing_trees(table("repo string, tree string", ("r", "master"), ("r", "new")), stored).collect() == [("r", "new")]


def test_only_changed_folders_are_read(spark, table, tmp_path, monkeypatch):
    files = [("r", t, f"top{i % 20}/f{i}/x{k}", "1") for t in ("old", "new") for i in range(200) for k in range(3)]
    files = [(r, t, p, "2" if (t, p) == ("new", "top7/f7/x1") else b) for r, t, p, b in files]
    trees.store_trees(table(FILES, *files), str(tmp_path))
    pairs = table("repo string, discrepancy string, left_tree string, right_tree string", ("r", "d", "old", "new"), ("r", "same", "old", "old"))
    read = []
    real = trees._of_either
    monkeypatch.setattr(trees, "_of_either", lambda p, entries, on, c: read.append(entries) or real(p, entries, on, c))
    got = trees.stored_diff(trees.read_trees(spark, str(tmp_path)), pairs)
    assert rows(got) == [("r", "d", "top7/f7/x1", "M", "1", "2")]
    assert len(read) == 4  # the roots, and a step for each folder on the way
    assert read[-1].count() < 60 and all("bucket" in e._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200] for e in read[1:])


def test_stored_twice_and_empty(spark, table, tmp_path):
    files = table(FILES, ("r", "a", "p/q", "1"), ("r", "b", "p/q", "2"))
    base = str(tmp_path / "trees")
    pairs = table("repo string, discrepancy string, left_tree string, right_tree string", ("r", "d", "a", "b"), ("r", "e", None, "b"))
    assert trees.stored_diff(trees.read_trees(spark, base), pairs).count() == 0
    trees.store_trees(files.where("false"), base)
    trees.store_trees(files, base)
    trees.store_trees(files, base)
    got = rows(trees.stored_diff(trees.read_trees(spark, base), pairs))
    assert got == [("r", "d", "p/q", "M", "1", "2"), ("r", "e", "p/q", "A", None, "2")]


# Patch ids from contents


def test_ranges_lead_from_one_text_to_the_other():
    random.seed(1)
    for _ in range(500):
        a = [random.choice("abcdefghijklmnop") for _ in range(random.randint(0, 14))]
        b = list(a)
        for _ in range(random.randint(0, 4)):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 2)] = random.choices("abcxyz", k=random.randint(0, 2))
        out, end = [], 0
        for i, k, j, l in changed_ranges(a, b):
            assert i >= end and (k > i or l > j)
            out += [*a[end:i], *b[j:l]]
            assert len(out) == l
            end = k
        assert [*out, *a[end:]] == b


def test_hash_of_hunks():
    old, new = text(*L), text(*L[:10], "new", *L[10:])
    head = text(*[f"head {i}" for i in range(9)])
    assert diff_hash(old, new) == diff_hash(f"{head}\n{old}", f"{head}\n{new}")
    assert diff_hash(old, new) == diff_hash(old.replace(" ", "\t "), new)[:0] + diff_hash(old, new.replace("new", " n ew "))
    assert diff_hash(old, new) != diff_hash(old, text(*L[:11], "new", *L[11:]))  # other lines around it
    assert diff_hash(old, new, 0) == diff_hash(old, text(*L[:11], "new", *L[11:]), 0)
    assert diff_hash(old, new) != diff_hash(new, old)
    assert diff_hash(None, old) != diff_hash(old, None) and diff_hash(old, old) == diff_hash(None, None)
    moved = diff_hash(text(*L), text(*L[:2], "p", *L[2:17], "q", *L[17:]))
    assert moved != diff_hash(text(*L), text(*L[:2], "p", *L[2:]))
    one, two = text(*["same"] * 40_000, "a"), text(*["same"] * 40_000, "b")
    assert diff_hash(one, two) == diff_hash(text(*["same"] * 4, "a"), text(*["same"] * 4, "b"))


def test_commits_with_one_change_get_one_id(table):
    head = text(*[f"head {i}" for i in range(9)])
    blobs = table(BLOBS, ("r", "o1", text(*L)), ("r", "n1", text(*L[:9], "+", *L[9:])), ("r", "o2", f"{head}\n{text(*L)}"), ("r", "n2", f"{head}\n{text(*L[:9], '+', *L[9:])}"), ("r", "bin", None), ("r", "bin2", None))
    changes = table(
        "repo string, sha string, path string, old_blob string, new_blob string",
        ("r", "c1", "p", "o1", "n1"), ("r", "c2", "p", "o2", "n2"), ("r", "c3", "other", "o1", "n1"), ("r", "c4", "p", None, "o1"), ("r", "c5", "p", "o1", None),
        ("r", "c6", "p", "bin", "bin2"), ("r", "c7", "p", "bin2", "bin"), ("r", "c8", "p", "bin", "bin2"),
    )
    found = history.diff_hashes(changes, blobs)
    ids = {r.sha: r.patch_id for r in history.patch_fingerprint(found).collect()}
    assert len(ids) == 8 and ids["c1"] == ids["c2"] and ids["c6"] == ids["c8"]
    assert len({ids[c] for c in ("c1", "c3", "c4", "c5", "c6", "c7")}) == 6


CHANGES = "repo string, sha string, path string, old_blob string, new_blob string"


@pytest.mark.parametrize("most", [wanted.MOST_NUMBERS, 500])
def test_hashes_are_those_of_whole_texts(table, monkeypatch, most):
    """Also if lines are asked for by several filters; a text that is listed without its content and with it has the content."""
    monkeypatch.setattr(history, "MOST_NUMBERS", most)
    rng = random.Random(5)
    texts = {"empty": "", "end": "\n\n", "bin": None, "blank": " \t", "é": "é\r\nß\x0bz\n"}
    for n in range(30):
        lines = [f"{rng.randint(0, 60)} é {'x' * rng.randint(0, 9)}" for _ in range(rng.randint(1, 60))]
        texts[f"{n}a"] = text(*lines)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(lines))
            lines[at : at + rng.randint(0, 2)] = [f"new {rng.random()}"] * rng.randint(0, 3)
        texts[f"{n}b"] = text(*lines)
    names = [*texts, None]
    pairs = [(f"{n}a", f"{n}b") for n in range(30)] + [(rng.choice(names), rng.choice(names)) for _ in range(60)]
    pairs += [(None, None), (None, "empty"), ("empty", None), (None, "3a"), ("3a", None), ("bin", None), ("lost", "3a"), ("empty", "3a")]
    blobs = table(BLOBS, *[("r", n, t) for n, t in texts.items()], ("r", "3a", None), ("r", "3a", texts["3a"]), ("r", None, "no name"), (None, "3a", "no repo"))
    changes = table(CHANGES, *[("r", str(n), "p", *pair) for n, pair in enumerate(pairs)], (None, "none", "p", None, None), (None, "lost", "p", None, "3a"))
    found = {r.sha: r.diff_hash for r in history.diff_hashes(changes, blobs).collect()}
    assert len(found) == len(pairs) + 2 and found.pop("none") == diff_hash(None, None)
    known = {str(n): pair for n, pair in enumerate(pairs) if not {"bin", "lost"} & set(pair)}
    assert {sha: found[sha] for sha in known} == {sha: diff_hash(*[texts[b] if b else None for b in pair]) for sha, pair in known.items()}
    named = {str(n): hashlib.sha256("|".join(b or "" for b in pair).encode()).hexdigest() for n, pair in enumerate(pairs) if str(n) not in known}
    assert {sha: found[sha] for sha in named} == named and found["lost"] == hashlib.sha256(b"|3a").hexdigest()


def shuffled(plan) -> int:
    """Bytes of the rows that the exchanges of an executed plan have moved."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("dataSize").value() if name == "Exchange" else 0
    children = plan.children()
    return own + sum(shuffled(children.apply(k)) for k in range(children.size()))


def test_lines_outside_of_hunks_are_not_moved(table, monkeypatch):
    """Less than half of the texts is shuffled, also if their table is made distinct before."""
    moved, cut = [], history.cut_lineage

    def counted(df, *label):
        df.collect()
        moved.append(shuffled(df._jdf.queryExecution().executedPlan()))
        return cut(df, *label)

    monkeypatch.setattr(history, "cut_lineage", counted)
    rng = random.Random(3)
    blobs, changes = [], []
    for n in range(12):
        lines = [rng.randbytes(50).hex() for _ in range(300)]
        at = rng.randint(0, 300)
        blobs += [("r", f"o{n}", text(*lines)), ("r", f"n{n}", text(*lines[:at], "new", *lines[at:]))]
        changes.append(("r", f"c{n}", "p", f"o{n}", f"n{n}"))
    contents = table(BLOBS, *blobs)
    found = history.diff_hashes(table(CHANGES, *changes), contents.union(contents).distinct()).collect()
    texts = {b: t for _, b, t in blobs}
    assert {r.sha: r.diff_hash for r in found} == {sha: diff_hash(texts[o], texts[n]) for _, sha, _, o, n in changes}
    assert 0 < sum(moved) < sum(len(t) for t in texts.values()) / 2


def test_shuffles_are_kept_again_after_a_step(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key) == before == "false"


def test_filter_finds_all_that_was_put_in_and_few_others():
    contents = [wanted.content_number("r", str(n)) for n in range(2_000)]
    numbers = wanted.line_numbers(contents, [-2] * 2_000, [k % 9 for k in range(2_000)])
    assert len(numbers) == len(np.unique(numbers)) == sum(k % 9 + 2 for k in range(2_000))
    assert list(wanted.line_numbers(contents[:2], [1, 0], [2, 1])) == [wanted.line_numbers(contents[:1], [0], [2])[1], wanted.line_numbers(contents[1:2], [0], [1])[0]]
    words = wanted.words_for(len(numbers))
    parts = wanted.segment(numbers)
    found = np.frombuffer(b"".join(wanted.fill_segment(numbers[parts == n], words) for n in range(wanted.SEGMENTS)), np.uint64)
    assert len(found) == words and wanted.stands(numbers, found).all()
    others = wanted.line_numbers(contents, [100] * 2_000, [120] * 2_000)
    assert wanted.stands(others, found).mean() < 0.03
    assert wanted.words_for(0) == wanted.SEGMENTS and wanted.words_for(1 << 40) == wanted.MOST_WORDS


def test_white_space_costs_less_than_translating_it():
    """The lines of a diff are read faster than ``str.translate`` alone would take out their white space."""
    old = "\n".join(f"select  é{i},\tb from t\r" for i in range(30_000))
    blanks = str.maketrans("", "", " \t\r\x0b\x0c")

    def seconds(function):
        took = []
        for _ in range(3):
            start = time.process_time()
            function()
            took.append(time.process_time() - start)
        return min(took)

    assert diff_hash(old, f"{old}\nlast") == diff_hash(old.translate(blanks), f"{old}\nlast".translate(blanks))
    assert seconds(lambda: diff_hash(old, f"{old}\nlast")) < seconds(lambda: (old.translate(blanks), f"{old}\nlast".translate(blanks)))
