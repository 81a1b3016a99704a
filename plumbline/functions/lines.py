"""The straight lines of one repository's history: places of new commits on them, and what tips reach of them."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

#: Stands for a number that is missing: a parent without an index comes before the others.
MISSING = -(1 << 63)


class Repository:
    """Rows of one repository in a stored ancestry, and the rows that new commits and tips add to them.

    The tables are those of :mod:`plumbline.operators.ancestry`; ``kept`` are the stored trunks whose steps still hold,
    and the stored steps are live ones.
    """

    def __init__(self, repo: str):
        self.repo = repo
        self.given: set[tuple] = set()
        self.wanted: set[str] = set()
        self.placed: dict[str, tuple[str, int]] = {}
        self.records: set[str] = set()
        self.crossing: list[tuple] = []
        self.trunks: set[str] = set()
        self.kept: set[str] = set()
        self.reach: list[tuple] = []

    def add(self, kind: str, a: str | None, b: str | None, m: int, n: int) -> None:
        if kind == "given":
            self.given.add((a, b, m))
        elif kind == "placed":
            self.placed[a] = (b, m)
        elif kind == "crossing":
            self.crossing.append((a, m, b, n))
        elif kind == "reach":
            self.reach.append((a, b, n))
        else:
            getattr(self, kind).add(a)

    def extend(self) -> Iterator[tuple]:
        """New rows: repo, table, its two texts and its two numbers; a single row ``cycle`` if the first parents have one.

        A row of ``placed`` has 1 as its second number if its commit has a record; only other records are rows of ``records``.
        """
        repo, old = self.repo, self.placed
        records = [row for row in self.given if row[0] not in self.records]
        edges = {(sha, parent) for sha, parent, _ in records if parent is not None}
        named = {row[0] for row in records}
        late = not named.isdisjoint(old)
        nodes = (named | {parent for _, parent in edges} | self.wanted) - old.keys()
        new = self._place(nodes, records)
        if new is None:
            yield repo, "cycle", None, None, None, None
            return
        if late:
            yield repo, "resets", None, None, None, None
        for sha in named - new.keys():
            yield repo, "records", sha, None, None, None
        for sha, (chain, pos) in new.items():
            yield repo, "placed", sha, chain, pos, int(sha in named)
        at = old | new
        added = [(*at[sha], *at[parent]) for sha, parent in edges if at[sha][0] != at[parent][0]]
        for chain, pos, to, top in added:
            yield repo, "crossing", chain, to, pos, top
        kept = set() if late else self.kept
        begun = ({at[sha][0] for sha in self.wanted} | self.trunks) - kept
        for trunk in begun:
            yield repo, "trunks", trunk, None, None, None
        yield from self._climb(added, kept, begun, [] if late else self.reach)

    def _place(self, nodes: set[str], records: list[tuple]) -> dict[str, tuple[str, int]] | None:
        """Lines through new commits: on from the child with the most descendants, the longest at the end of a stored line."""
        least: dict[str, tuple] = {}
        for sha, parent, index in records:
            if parent is not None and sha in nodes:
                rank = (index, parent)
                if sha not in least or rank < least[sha]:
                    least[sha] = rank
        main = {sha: rank[1] for sha, rank in least.items()}
        below = {sha: parent for sha, parent in main.items() if parent in nodes}
        size, children = dict.fromkeys(nodes, 1), dict.fromkeys(nodes, 0)
        for parent in below.values():
            children[parent] += 1
        order = [sha for sha, n in children.items() if not n]
        for sha in order:  # grows on the way
            parent = below.get(sha)
            if parent is not None:
                size[parent] += size[sha]
                children[parent] -= 1
                if not children[parent]:
                    order.append(parent)
        if len(order) < len(nodes):
            return None
        heir: dict[str, str] = {}
        for sha, parent in below.items():
            if parent not in heir or (size[sha], sha) > (size[heir[parent]], heir[parent]):
                heir[parent] = sha
        own: dict[str, tuple[str, int]] = {}
        length: dict[str, int] = {}
        for sha in reversed(order):  # parents first
            parent = below.get(sha)
            own[sha] = (own[parent][0], own[parent][1] + 1) if parent is not None and heir[parent] == sha else (sha, 0)
            length[own[sha][0]] = own[sha][1]
        end: dict[str, int] = {}
        for chain, pos in self.placed.values():
            end[chain] = max(end.get(chain, 0), pos)
        best: dict[str, tuple] = {}
        for chain, top in length.items():
            onto, pos = self.placed.get(main.get(chain), (None, None))
            if onto is not None and end[onto] == pos:
                best[onto] = max(best.get(onto, (-1, "")), (top, chain))
        onto = {chain: line for line, (_, chain) in best.items()}
        return {
            sha: (onto[chain], end[onto[chain]] + 1 + pos) if chain in onto else (chain, pos) for sha, (chain, pos) in own.items()
        }

    def _climb(self, added: list[tuple], kept: set[str], begun: set[str], reach: list[tuple]) -> Iterator[tuple]:
        """Steps of the trunks: from low to high positions, each edge is followed from the lowest position that reaches it."""
        away: dict[str, list[tuple]] = defaultdict(list)
        for chain, pos, to, top in self.crossing + added:
            away[chain].append((pos, to, top))
        for edges in away.values():
            edges.sort()
        places = {chain: [edge[0] for edge in edges] for chain, edges in away.items()}
        starts: dict[str, list[tuple]] = defaultdict(list)
        for chain, *edge in added:
            if chain in kept:
                starts[chain].append(tuple(edge))
        for trunk in begun:
            if trunk in away:
                starts[trunk] = away[trunk]
        floors: dict[str, dict[str, int]] = defaultdict(dict)
        for trunk, chain, top in reach:
            if trunk in starts:
                floors[trunk][chain] = max(floors[trunk].get(chain, -1), top)
        for trunk, edges in starts.items():
            tops = floors[trunk]
            todo = sorted(edges, reverse=True)
            while todo:
                at, risen, ahead = todo[-1][0], set(), []
                while todo and todo[-1][0] == at:
                    ahead.append(todo.pop()[1:])
                while ahead:
                    chain, top = ahead.pop()
                    before = tops.get(chain, -1)
                    if top <= before or chain == trunk:
                        continue
                    tops[chain] = top
                    risen.add(chain)
                    if chain in away:
                        where = places[chain]
                        ahead.extend(edge[1:] for edge in away[chain][bisect_right(where, before) : bisect_right(where, top)])
                for chain in risen:
                    yield self.repo, "reach", trunk, chain, at, tops[chain]
