"""Uses and record counts of every term of a collection, counted in burst tries."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import PY_TERM, has_text
from millrace.plans.store import materialize

#: Entries of a container before it bursts into one container per next character.
BURST = 4096
#: Entries of a task's trie before its subtrees are handed on and it is begun anew.
HOLD = 500_000
#: Entries that meet under one route; a route of more is parted by the next character.
MEET = 1_000_000
#: Terms whose counters a task finds without walking the trie.
FRONT = 200_000
#: Uses counted at a time.
STEP = 1_000_000


class _Node:
    """Either a container of term rests (leaf: rest to counter) or a branching on one character (kids), with the counter of the term that ends here."""

    __slots__ = ("end", "kids", "leaf")

    def __init__(self):
        self.leaf: dict[str, int] | None = {}
        self.kids: dict | None = None
        self.end: int | None = None


class BurstTrie:
    """Terms with a counter of uses and one of records, kept in two compact arrays; the trie leads from a term to its place in
    them. A container that holds too many terms bursts, so crowded prefixes get longer routes than rare ones."""

    def __init__(self, burst: int = BURST):
        self.root, self.burst, self.size = _Node(), burst, 0
        self.uses, self.records = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def _fresh(self) -> int:
        self.size += 1
        if self.size > len(self.uses):
            self.uses, self.records = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.uses, self.records))
        return self.size - 1

    def place(self, term: str) -> int:
        """The term's counter; a new one if the trie doesn't hold the term."""
        node, k = self.root, 0
        while node.kids is not None:
            if k == len(term):
                if node.end is None:
                    node.end = self._fresh()
                return node.end
            nxt = node.kids.get(term[k])
            if nxt is None:
                nxt = node.kids[term[k]] = _Node()
            node, k = nxt, k + 1
        rest = term[k:]
        at = node.leaf.get(rest)
        if at is None:
            at = node.leaf[rest] = self._fresh()
            if len(node.leaf) > self.burst:
                self._burst(node)
        return at

    @staticmethod
    def _burst(node: _Node) -> None:
        node.kids = {}
        for rest, at in node.leaf.items():
            if rest:
                if (kid := node.kids.get(rest[0])) is None:
                    kid = node.kids[rest[0]] = _Node()
                kid.leaf[rest[1:]] = at
            else:
                node.end = at
        node.leaf = None

    def count(self, places: np.ndarray, record: np.ndarray) -> None:
        """Adds a use for each place, and a record for each pair of place and record."""
        if not len(places):
            return
        n = len(self.uses)
        self.uses += np.bincount(places, minlength=n)
        pairs = np.sort(record * n + places)
        self.records += np.bincount(pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] % n, minlength=n)

    def add(self, term: str, uses: int, records: int) -> None:
        at = self.place(term)
        self.uses[at] += uses
        self.records[at] += records

    def subtrees(self) -> Iterator[tuple[str, dict[str, int] | None]]:
        """(prefix, container) in the order of the prefixes. A branching comes as (prefix, None); the term that ends there as the rest ''."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node.kids is None:
                if node.leaf:
                    yield prefix, node.leaf
                continue
            yield prefix, None
            if node.end is not None:
                yield prefix, {"": node.end}
            stack.extend((prefix + c, node.kids[c]) for c in sorted(node.kids, reverse=True))


class _Front(dict):
    """The places of terms met before; others are looked up in the trie."""

    def __init__(self, trie: BurstTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, term: str) -> int:
        at = self.trie.place(term)
        if len(self) < FRONT:
            self[term] = at
        return at


_CONTAINER = "prefix string, rests array<string>, uses array<long>, records array<long>"
_NAMES = ["prefix", "rests", "uses", "records"]
_TYPES = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, _TYPES, strict=True)], names=_NAMES)


def _count(burst: int, hold: int):
    find = re.compile(PY_TERM).findall

    def out(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for prefix, leaf in trie.subtrees():
            if leaf is None:
                rows.append((prefix, None, None, None))
                continue
            rests = sorted(leaf)
            at = np.array([leaf[r] for r in rests])
            rows.append((prefix, rests, trie.uses[at], trie.records[at]))
            size += len(rests)
            if size > 50_000:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, n = BurstTrie(burst), 0
        front = _Front(trie)
        for rows in batches:
            n += rows.num_rows
            flat: list[int] = []
            sizes: list[int] = []
            texts = rows.column(0).to_pylist()
            for k, text in enumerate(texts):
                before = len(flat)
                flat.extend(map(front.__getitem__, find(text.lower())))
                sizes.append(len(flat) - before)
                if len(flat) >= STEP or k == len(texts) - 1:
                    trie.count(np.array(flat, np.int64), np.repeat(np.arange(len(sizes)), sizes))
                    flat, sizes = [], []
            if trie.size >= hold:
                yield from out(trie)
                trie = BurstTrie(burst)
                front = _Front(trie)
        yield from out(trie)
        yield _rows([(None, None, None, [n])])

    return run


def _route(inner: frozenset[str]):
    """Containers under the routes that all tasks share: where another task's trie branches, a container is parted likewise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pa.array(sorted(inner), pa.string())
        for batch in batches:
            apart = pc.is_in(batch.column(0), split)
            whole = batch.filter(pc.invert(apart))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(whole.columns, _TYPES, strict=True)], names=_NAMES)
            rows = []
            for r in batch.filter(apart).to_pylist():
                kids: dict[str, tuple[list, list, list]] = {}
                for rest, u, n in zip(r["rests"], r["uses"], r["records"], strict=True):
                    key, k = r["prefix"], 0
                    while key in inner and k < len(rest):
                        key, k = key + rest[k], k + 1
                    for x, v in zip(kids.setdefault(key, ([], [], [])), (rest[k:], u, n), strict=True):
                        x.append(v)
                rows.extend((key, *x) for key, x in kids.items())
            if rows:
                yield _rows(rows)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matching subtrees arrive together: their containers are united and the counters of equal rests added. A route may cross batches."""

    def united(cells: pa.Table) -> pa.Table:
        return cells.group_by(["prefix", "rest"], use_threads=False).aggregate([("uses", "sum"), ("records", "sum")]).rename_columns(["prefix", "rest", "uses", "records"])

    def out(cells: pa.Table) -> Iterator[pa.RecordBatch]:
        term = pc.binary_join_element_wise(cells.column("prefix"), cells.column("rest"), "")
        yield from pa.table([term, cells.column("uses"), cells.column("records")], names=["term", "uses", "records"]).to_batches()

    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rests = batch.column(1)
        of = pc.list_parent_indices(rests)
        cells = pa.table([batch.column(0).take(of), rests.flatten(), batch.column(2).flatten(), batch.column(3).flatten()], names=["prefix", "rest", "uses", "records"])
        if carry is not None:
            cells = pa.concat_tables([carry, cells])
        if not cells.num_rows:
            continue
        cells = united(cells)
        last = pc.equal(cells.column("prefix"), batch.column(0)[-1])
        carry = cells.filter(last)
        yield from out(cells.filter(pc.invert(last)))
    if carry is not None:
        yield from out(carry)


def term_frequency(df: DataFrame, text: str, rare: int = 2, common: float = 0.32, burst: int = BURST, hold: int = HOLD, meet: int = MEET) -> DataFrame:
    """Every distinct term of a text column: uses, records holding it, all records (n), and mark.

    mark is 'rare' if at most `rare` records hold the term, else 'common' if more than the share `common` of all
    records hold it (in millionths, whole-number arithmetic), else null.

    Each task counts into a burst trie and hands on its subtrees as packed containers (prefix, rests, counters), at the end or
    when the trie holds `hold` terms. A prefix at which any task's trie branches is a branching for all: containers of
    tasks that saw fewer such terms are parted there, so equal terms have equal routes. Matching subtrees cross the
    exchange by their route and are united, their counters added; a term comes at most once a task and flush, however hot
    it is, and a route on which more than `meet` entries would come together branches once more. The driver
    holds the branchings: one for every `burst` terms or more, not the terms.

    Null and blank texts don't count as records. A text without terms counts as a record. Other columns are ignored.
    An empty table gives no rows.
    """
    texts = df.select(text).where(has_text(text))
    counted = materialize(texts.mapInArrow(_count(burst, hold), _CONTAINER))
    facts = counted.agg(
        F.sum(F.when(F.col("prefix").isNull(), F.get("records", F.lit(0)))).alias("n"),
        F.collect_set(F.when(F.col("rests").isNull(), F.col("prefix"))).alias("inner"),
        F.sum(F.when(F.col("rests").isNotNull(), F.size("rests"))).alias("entries"),
    ).first()
    n, inner = facts["n"] or 0, frozenset(facts["inner"])
    leaves = counted.where(F.col("rests").isNotNull())
    while True:
        routed = leaves.mapInArrow(_route(inner), _CONTAINER) if inner else leaves
        if (facts["entries"] or 0) <= meet:
            break
        crowded = routed.groupBy("prefix").agg(F.sum(F.size("rests")).alias("c"), F.max(F.array_max(F.transform("rests", F.length))).alias("long"))
        more = frozenset(r["prefix"] for r in crowded.where((F.col("c") > meet) & (F.col("long") > 0)).select("prefix").collect()) - inner
        if not more:
            break
        inner |= more
    merged = routed.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_merge, "term string, uses long, records long")
    part = F.lit(round(common * 1_000_000)).cast("decimal(19,0)") * F.lit(n)
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records").cast("decimal(19,0)") * 1_000_000 > part, "common")
    return merged.select("term", "uses", "records", F.lit(n).cast("long").alias("n"), mark.alias("mark"))
