import random
from datetime import datetime


from plumbline.operators import history
from tests.conftest import rows

PARENTS = "repo string, sha string, parent_sha string, parent_index int"
TIPS = "repo string, branch string, sha string"


def walk(edges, start):
    seen, todo = set(), [start]
    while todo:
        sha = todo.pop()
        if sha not in seen:
            seen.add(sha)
            todo += edges.get(sha, [])
    return seen


def graph(table, edges, tips, repo="r"):
    parent_rows = [(repo, c, p, i) for c, ps in edges.items() for i, p in enumerate(ps or [None])]
    return table(PARENTS, *parent_rows), table(TIPS, *[(repo, b, s) for b, s in tips.items()])


def brute(edges, tips, repo="r"):
    return sorted([(repo, b, s) for b, t in tips.items() for s in walk(edges, t)], key=repr)


def test_long_line(table):
    edges = {f"c{i:03}": [f"c{i - 1:03}"] if i else [] for i in range(150)}
    tips = {"master": "c149", "test": "c100", "production": "c000"}
    parents, tip_rows = graph(table, edges, tips)
    assert rows(history.reachable(parents, tip_rows)) == brute(edges, tips)
    placed = {r.sha: (r.chain, r.pos) for r in history.chains(parents, tip_rows).collect()}
    assert placed["c149"] == ("c000", 149)


def test_diamond_two_roots_and_lonely_tip(table):
    edges = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"], "x": [], "e": ["d", "x"]}
    tips = {"master": "e", "test": "d", "production": "z"}
    parents, tip_rows = graph(table, edges, tips)
    assert rows(history.reachable(parents, tip_rows)) == brute(edges, tips)


def test_random_graphs(table):
    rng = random.Random(7)
    parent_rows, tip_rows, wanted = [], [], []
    for g in range(12):
        n, edges = 40, {}
        for i in range(n):
            edges[f"s{i}"] = [f"s{j}" for j in rng.sample(range(i), min(i, rng.choice([1, 1, 1, 2, 3])))]
        tips = {"master": f"s{n - 1}", "test": f"s{n - 2}", "production": f"s{rng.randrange(n)}"}
        parent_rows += [(f"r{g}", c, p, i) for c, ps in edges.items() for i, p in enumerate(ps or [None])]
        tip_rows += [(f"r{g}", b, s) for b, s in tips.items()]
        wanted += brute(edges, tips, f"r{g}")
    closure = history.reachable(table(PARENTS, *parent_rows), table(TIPS, *tip_rows))
    found = rows(closure)
    assert found == sorted(wanted, key=repr)
    # Closed under parents, and every tip is in it.
    parents = {}
    for repo, c, p, _ in parent_rows:
        parents.setdefault((repo, c), []).append(p)
    members = set(found)
    assert all((r, b, s) in members for r, b, s in tip_rows)
    assert all((r, b, p) in members for r, b, s in found for p in parents[(r, s)] if p)


def test_merge_base_is_a_best_common_ancestor(table):
    edges = {"a": [], "b": ["a"], "c": ["b"], "d": ["b"], "e": ["c"], "f": ["d"]}
    tips = {"master": "e", "test": "f", "production": "a"}
    parents, tip_rows = graph(table, edges, tips)
    bases = history.merge_bases(history.reachable(parents, tip_rows), parents)
    assert rows(bases) == [("r", "master", "production", "a"), ("r", "master", "test", "b"), ("r", "test", "production", "a")]


def test_unrelated_branches_have_no_base(table):
    parents, tips = graph(table, {"a": [], "b": []}, {"master": "a", "test": "b"})
    assert rows(history.merge_bases(history.reachable(parents, tips), parents)) == []


def test_branch_gap(table, spark):
    edges = {"a": [], "b": ["a"], "c": ["b"]}
    parents, tips = graph(table, edges, {"master": "c", "production": "a"})
    tips = tips.union(table(TIPS, ("same", "master", "q"), ("same", "production", "q"), ("alone", "master", "w"), ("late", "production", "v")))
    repos = table("repo string", ("r",), ("same",), ("alone",), ("late",), ("empty",))
    day = {"a": 1, "b": 5, "c": 3, "q": 1, "w": 1, "v": 1}
    repo_of = {"q": "same", "w": "alone", "v": "late"}
    commits = table(
        "repo string, sha string, authored_at timestamp", *[(repo_of.get(s, "r"), s, datetime(2024, 1, d, 12)) for s, d in day.items()]
    )
    closure = history.reachable(parents, tips)
    gap = history.branch_gap(repos, tips, closure, commits, "master", "production", datetime(2024, 1, 10))
    found = {r.repo: r for r in gap.collect()}
    assert (found["r"].status, found["r"].source_commits_not_in_target, found["r"].target_commits_not_in_source) == ("waiting for sync", 2, 0)
    assert found["r"].waiting_days == 6 and found["r"].oldest_source_commit_not_in_target == datetime(2024, 1, 3, 12)
    assert (found["same"].status, found["same"].waiting_days) == ("in sync", 0)
    assert (found["alone"].status, found["alone"].target_branch_present) == ("no origin/production", "missing")
    assert (found["late"].status, found["late"].target_branch_present) == ("no origin/master", "unknown")
    assert found["late"].last_target_commit is None
    assert found["empty"].status == "no origin/master"


def test_patch_fingerprint_ignores_order(table):
    diffs = table(
        "repo string, sha string, path string, diff_hash string",
        ("r", "1", "a", "x"), ("r", "1", "b", "y"), ("r", "2", "b", "y"), ("r", "2", "a", "x"), ("r", "3", "a", "y"), ("r", "3", "b", "x"),
    )
    ids = {r.sha: r.patch_id for r in history.patch_fingerprint(diffs).collect()}
    assert ids["1"] == ids["2"] != ids["3"]


def test_file_meta_prefers_latest_add(table):
    commits = table(
        "repo string, sha string, authored_at timestamp, author string, author_email string, message string",
        *[("r", s, datetime(2024, 1, d), s, s, s) for s, d in (("1", 1), ("2", 2), ("3", 3))],
    )
    touched = table("repo string, sha string, path string, change_code string", ("r", "1", "f", "A"), ("r", "2", "f", "A"), ("r", "3", "f", "M"))
    closure = table("repo string, branch string, sha string", *[("r", "master", s) for s in "123"])
    row = history.file_meta(closure, commits, touched).first()
    assert (row.created_commit, row.last_change_commit, row.first_added_commit) == ("2", "3", "1")


def test_rounds_carry_climbing_commits_only(table, monkeypatch):
    """Commits at the end of their line are not written again, and sizes are those of whole lines."""
    seen = []
    cut = history.cut_and_count
    monkeypatch.setattr(history, "cut_and_count", lambda df, condition, label="step": (seen.append(out := cut(df, condition, label)), out)[1])
    nodes = table("repo string, sha string", *[("r", f"{i:03}") for i in range(40)], ("r", "side"))
    main = table("repo string, sha string, parent_sha string", *[("r", f"{i:03}", f"{i - 1:03}") for i in range(1, 40)], ("r", "side", "009"))
    sizes = {r.sha: r.size for r in history.descendants(nodes, main).collect()}
    assert sizes == {**{f"{i:03}": 40 - i + (i <= 9) for i in range(40)}, "side": 1}
    active = [n for _, n in seen]
    assert active == sorted(active, reverse=True) and active[-1] == 0
    assert all(state.count() <= 2 * before for (state, _), before in zip(seen[1:], active))


def test_file_meta_moves_touched_files_once(table):
    """Branches are unfolded behind the exchange by path, so a file touched on three branches is moved as one row."""
    commits = table("repo string, sha string, authored_at int, author string, author_email string, message string", ("r", "1", 1, "a", "a@x", "m"), ("r", "2", 2, "b", "b@x", "n"))
    touched = table("repo string, sha string, path string, change_code string", ("r", "1", "p", "A"), ("r", "2", "p", "M"))
    closure = table("repo string, branch string, sha string", *[("r", b, "1") for b in ("master", "test", "production")], ("r", "master", "2"))
    found = history.file_meta(closure, commits, touched)
    got = sorted((r.branch, r.path, r.created_commit, r.last_change_commit, r.first_added_commit) for r in found.collect())
    assert got == [("master", "p", "1", "2", "1"), ("production", "p", "1", "1", "1"), ("test", "p", "1", "1", "1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(branches") < plan.index("RepartitionByExpression")
