import random

import pytest

from plumbline.operators import ancestry, history
from tests.conftest import rows
from tests.test_history import PARENTS, TIPS, brute


def records(table, edges, shas, repo="r"):
    return table(PARENTS, *[(repo, c, p, i) for c in shas for i, p in enumerate(edges[c] or [None])])


def tip_rows(table, tips, repo="r"):
    return table(TIPS, *[(repo, b, s) for b, s in tips.items()])


def written(spark, base, gen):
    """Rows of a generation over all tables."""
    tables = [ancestry.read_table(spark, base, name, gen + 1).where(f"gen = {gen}").count() for name in ancestry.TABLES]
    return sum(tables)


def test_generations_equal_one_pass(spark, table, tmp_path):
    rng, base = random.Random(5), str(tmp_path / "index")
    graphs = {}
    for g in range(8):
        graphs[f"r{g}"] = {f"s{i:02}": [f"s{j:02}" for j in rng.sample(range(max(0, i - 9), i), min(i, rng.choice([1, 1, 2, 3])))] for i in range(40)}
    for end in (12, 13, 27, 40):
        parents, tips, wanted = [], [], []
        for repo, edges in graphs.items():
            own = {"master": f"s{end - 1:02}", "test": f"s{rng.randrange(end):02}", "production": f"s{rng.randrange(end):02}"}
            parents += [(repo, c, p, i) for c, ps in edges.items() if int(c[1:]) < end for i, p in enumerate(ps or [None])]
            tips += [(repo, b, s) for b, s in own.items()]
            wanted += brute(edges, own, repo)
        frame = table(TIPS, *tips)
        ancestry.extend_index(base, table(PARENTS, *parents), frame, buckets=2)
        assert rows(ancestry.reachable_from_index(spark, base, frame)) == sorted(wanted, key=repr)


def test_main_line_writes_only_new_rows(spark, table, tmp_path):
    """A trunk with a merged side branch every third commit; the second run brings one in fifty commits."""
    base, edges = str(tmp_path / "index"), {}
    for i in range(200):
        below = [f"m{i - 1:03}"] if i else []
        if i % 3 == 2:
            edges[f"x{i:03}"] = [f"m{i - 2:03}"]
            below.append(f"x{i:03}")
        edges[f"m{i:03}"] = below
    old = [c for c in edges if int(c[1:]) < 196]
    first = tip_rows(table, {"master": "m195", "production": "m100"})
    ancestry.extend_index(base, records(table, edges, old), first, buckets=2)
    tips = {"master": "m199", "production": "m150"}
    ancestry.extend_index(base, records(table, edges, edges), tip_rows(table, tips), buckets=2)
    assert rows(ancestry.reachable_from_index(spark, base, tip_rows(table, tips))) == brute(edges, tips)
    assert written(spark, base, 0) > 600
    assert written(spark, base, 1) < 25
    assert ancestry.read_table(spark, base, "placed", 2).where("sha = 'm199' AND chain = 'm000' AND pos = 199").count() == 1
    ancestry.extend_index(base, records(table, edges, edges), tip_rows(table, tips), buckets=2)
    assert written(spark, base, 2) == 0


def test_two_lines_that_merge_each_other(spark, table, tmp_path):
    base, edges = str(tmp_path / "index"), {"a00": [], "b00": ["a00"]}
    for i in range(1, 30):
        edges[f"a{i:02}"] = [f"a{i - 1:02}"] + ([f"b{i - 1:02}"] if i % 4 == 0 else [])
        edges[f"b{i:02}"] = [f"b{i - 1:02}"] + ([f"a{i - 1:02}"] if i % 5 == 0 else [])
    for end in (9, 20, 30):
        tips = {"master": f"a{end - 1:02}", "test": f"b{end - 1:02}", "production": f"a{end // 2:02}"}
        ancestry.extend_index(base, records(table, edges, [c for c in edges if int(c[1:]) < end]), tip_rows(table, tips), buckets=2)
        assert rows(ancestry.reachable_from_index(spark, base, tip_rows(table, tips))) == brute(edges, tips)


def test_late_records_take_steps_back(spark, table, tmp_path):
    base = str(tmp_path / "index")
    edges = {"a": [], "b": ["a"], "c": ["b"], "x": ["a"], "d": ["c", "x"]}
    tips = {"master": "d", "test": "x"}
    ancestry.extend_index(base, records(table, edges, ["c", "d"]), tip_rows(table, tips), buckets=2)
    cut_off = {"b": [], "x": [], "c": ["b"], "d": ["c", "x"]}
    assert rows(ancestry.reachable_from_index(spark, base, tip_rows(table, tips))) == brute(cut_off, tips)
    ancestry.extend_index(base, records(table, edges, ["a", "b", "x"]), tip_rows(table, tips), buckets=2)
    assert rows(ancestry.reachable_from_index(spark, base, tip_rows(table, tips))) == brute(edges, tips)


def test_ended_run_is_repeated(spark, table, tmp_path, monkeypatch):
    base = str(tmp_path / "index")
    edges = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}
    first, second = {"master": "b"}, {"master": "d", "test": "c"}
    ancestry.extend_index(base, records(table, edges, ["a", "b"]), tip_rows(table, first), buckets=2)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(ancestry, "_stairs", lost)
        with pytest.raises(RuntimeError, match="lost"):
            ancestry.extend_index(base, records(table, edges, edges), tip_rows(table, second), buckets=2)
    assert rows(ancestry.reachable_from_index(spark, base, tip_rows(table, first))) == brute(edges, first)
    assert ancestry.extend_index(base, records(table, edges, edges), tip_rows(table, second), buckets=2) == 1
    assert rows(ancestry.reachable_from_index(spark, base, tip_rows(table, second))) == brute(edges, second)


def test_empty_tables_null_rows_and_unknown_tips(spark, table, tmp_path):
    base = str(tmp_path / "index")
    nothing, no_tips = table(PARENTS), table(TIPS)
    assert ancestry.extend_index(base, nothing, no_tips, buckets=2) == 0
    assert rows(ancestry.reachable_from_index(spark, base, no_tips)) == []
    holes = table(PARENTS, ("r", None, "a", 0), (None, "a", None, 0), ("r", "b", "a", None), ("r", "b", "a", None))
    tips = table(TIPS, ("r", "master", "b"), ("r", "test", None))
    ancestry.extend_index(base, holes, tips, buckets=2)
    assert rows(ancestry.reachable_from_index(spark, base, tips)) == [("r", "master", "a"), ("r", "master", "b")]
    with pytest.raises(ValueError, match="tips"):
        ancestry.reachable_from_index(spark, base, table(TIPS, ("r", "master", "unknown")))


def test_same_as_unstored(spark, table, tmp_path):
    edges = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"], "x": [], "e": ["d", "x"]}
    tips = tip_rows(table, {"master": "e", "test": "d", "production": "z"})
    base = str(tmp_path / "index")
    ancestry.extend_index(base, records(table, edges, edges), tips, buckets=2)
    assert rows(ancestry.reachable_from_index(spark, base, tips)) == rows(history.reachable(records(table, edges, edges), tips))


def test_small_repositories_need_no_rounds(spark, table, tmp_path, monkeypatch):
    def rounds(*_):
        raise AssertionError("rounds of joins over small repositories")

    monkeypatch.setattr(ancestry, "chains", rounds)
    base, edges = str(tmp_path / "index"), {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}
    tips = {"master": "d", "test": "c"}
    ancestry.extend_index(base, records(table, edges, ["a", "b"]), tip_rows(table, {"master": "b"}), buckets=2)
    ancestry.extend_index(base, records(table, edges, edges), tip_rows(table, tips), buckets=2)
    assert rows(ancestry.reachable_from_index(spark, base, tip_rows(table, tips))) == brute(edges, tips)


def test_tasks_and_rounds_write_the_same(spark, table, tmp_path, monkeypatch):
    """Repositories of all sizes; some commits come late, some twice, some have no index of their parent."""
    rng = random.Random(11)
    graphs = {f"r{g}": {f"s{i:02}": [f"s{j:02}" for j in rng.sample(range(max(0, i - 6), i), min(i, rng.choice([1, 1, 2, 3])))] for i in range(4 + 6 * g)} for g in range(6)}
    calls = []
    for share in (0.5, 1.0):
        parents, tips = [], []
        for repo, edges in graphs.items():
            end = int(len(edges) * share)
            late = {f"s{end // 2:02}"} if share < 1 and repo in ("r2", "r4") else set()
            shas = [c for c in edges if int(c[1:]) < end and c not in late]
            parents += [(repo, c, p, rng.choice([i, None])) for c in shas for i, p in enumerate(edges[c] or [None])] * 2
            tips += [(repo, b, rng.choice(shas)) for b in ("master", "test")]
        calls.append((table(PARENTS, *parents), table(TIPS, *tips)))
    for base, small in (("tasks", 10_000), ("rounds", -1), ("both", 60)):
        monkeypatch.setattr(ancestry, "SMALL", small)
        for parents, tips in calls:
            ancestry.extend_index(str(tmp_path / base), parents, tips, buckets=2)
    for name in ancestry.TABLES:
        tasks, rounds, both = (rows(ancestry.read_table(spark, str(tmp_path / base), name, 2)) for base in ("tasks", "rounds", "both"))
        assert tasks and tasks == rounds == both, name


def test_cycle_in_a_small_repository(table, tmp_path):
    with pytest.raises(ValueError, match="cycle"):
        ancestry.extend_index(str(tmp_path / "index"), records(table, {"a": ["b"], "b": ["a"]}, "ab"), tip_rows(table, {"master": "a"}), buckets=2)
