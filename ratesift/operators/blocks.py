"""Pair statistics between all keys that share a dimension, without emitting the pairs.

Keys (users, or items) are hashed into m blocks of about ``block`` keys, and ratings travel packed per (dimension,
block). A directory lists the blocks that hold a dimension; a packed row is copied only to the pairs of its own block
with a block of that list. Two blocks that share no dimension meet nowhere, and two that do meet once, for both
directions. Each block pair is one unit of work: its rows arrive sorted by dimension, row combinations become codes of
two places, and equal codes are sorted and summed. A task holds the codes that occur, at most one per pair of keys of
two blocks, however often one dimension or key occurs; only reduced results (top k per key or query, sums) leave it.

Where keys meet few others (``_few_pairs`` tells by counts), block pairs would copy nearly every rating alone and reduce
next to nothing. There a block's keys meet the whole list of each dimension they hold, so that all neighbours of a key
are known in one task and only its k best leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from ratesift.operators.ordering import top_per_group
from ratesift.session import cleaned, durable

OUT = "key long, dim long, other long, sim double, val double, shared long, best_shared long, neighbours long"
OUT_NAMES = ["key", "dim", "other", "sim", "val", "shared", "best_shared", "neighbours"]
EXPAND = 2_000_000  # row combinations held at once inside a task
SPREAD = 3  # partitions of block pairs per shuffle partition, as pairs differ in work
HALF = 32  # a code is the left place above so many bits of the right place; a unit's name is made alike of two blocks
LOW = (1 << HALF) - 1
MEAN_PAIRS, MOST_PAIRS = 2000, 4_000_000  # entries met by a key, on average and at most, where whole lists are met
UNIT_PAIRS, ASKED_PAIRS = 1_000_000, 16_000_000  # pairs of facts, and combinations asked for, in a unit of whole lists
PASS_PAIRS = 500_000_000  # entries met and asked for in one pass over the units, which bounds the shuffle files held at once
PIECE = 4096  # entries of a list in one row; a longer list is not asked
FACTS, STRAIGHT, TURNED = 0, 1, 2  # phases of a unit: its facts, then queries of the left block, then of the right one


@dataclass(frozen=True)
class BlockPlan:
    similarity: str = "msd"  # msd | pearson | cosine
    reduce: str = "topk"  # summary | neighbours | topk | sum
    k: int = 40
    block: int = 2048


LIST_NAMES = ("keys", "vals", "others", "other_vals", "n_keys", "n_others")


class _Index:
    """Places of a block's keys, in order of appearance, and a weight for each."""

    def __init__(self):
        self.slots: dict[int, int] = {}
        self.weights = np.ones(256)

    def _mapped(self, keys: np.ndarray, place) -> np.ndarray:
        unique, inverse = np.unique(keys, return_inverse=True)
        return np.fromiter(map(place, unique.tolist()), np.int64, len(unique))[inverse]

    def add(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        places = self._mapped(keys, lambda k: self.slots.setdefault(k, len(self.slots)))
        if len(self.slots) > len(self.weights):
            self.weights = np.pad(self.weights, (0, 2 * len(self.slots) - len(self.weights)), constant_values=1)
        self.weights[places] = weights
        return places

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self._mapped(keys, lambda k: self.slots.get(k, -1))

    def ids(self) -> np.ndarray:
        return np.fromiter(self.slots, dtype=np.int64, count=len(self.slots))


def _summed(codes: np.ndarray, terms: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct codes in order, and the sums of each term over them."""
    if not len(codes):
        return codes, terms
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], [np.add.reduceat(t[order], first) for t in terms]


class _PairSums:
    """Sums over shared dimensions for the pairs of keys of two blocks that occur."""

    def __init__(self, plan: BlockPlan, same: bool):
        self.plan, self.same = plan, same
        self.left = _Index()
        self.right = self.left if same else _Index()
        self.parts: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.held = self.settled = 0

    def _terms(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        count = np.ones(len(x), dtype=np.int64)
        if self.plan.similarity == "msd":
            return [count, (x - y) ** 2]
        return [count] if self.plan.similarity == "cosine" else [count, x, y, x * x, y * y, x * y]

    def _merge(self) -> None:
        if len(self.parts) > 1:
            codes = np.concatenate([c for c, _ in self.parts])
            terms = [np.concatenate(t) for t in zip(*(t for _, t in self.parts))]
            self.parts = [_summed(codes, terms)]
        self.held = self.settled = len(self.parts[0][0]) if self.parts else 0

    def add(self, left, right) -> None:
        li, ri = self.left.add(left["key"], left["val"]), self.right.add(right["key"], right["val"])
        for a, b in _combinations(left["dim"], right["dim"]):
            if self.same:
                apart = li[a] != ri[b]
                a, b = a[apart], b[apart]
            self.parts.append(_summed(li[a] << HALF | ri[b], self._terms(left["val"][a], right["val"][b])))
            self.held += len(self.parts[-1][0])
            if self.held > max(EXPAND, 2 * self.settled):
                self._merge()

    def finish(self) -> "_Similar":
        self._merge()
        codes, (count, *sums) = self.parts[0] if self.parts else (np.empty(0, np.int64), [np.empty(0, np.int64)] * 6)
        c = count.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.plan.similarity == "msd":
                sim = 1 / (sums[0] / c + 1)
            elif self.plan.similarity == "cosine":
                sim = c / np.sqrt(self.left.weights[codes >> HALF] * self.right.weights[codes & LOW])
            else:
                x, y, xx, yy, xy = sums
                vx, vy = c * xx - x * x, c * yy - y * y
                sim = np.where((vx > 0) & (vy > 0), (c * xy - x * y) / np.sqrt(vx * vy), 0.0)
        return _Similar(self, codes, count, sim)


@dataclass(frozen=True)
class _Similar:
    """Similarities of the pairs that occur, by sorted code; keys are never similar to themselves."""

    sums: _PairSums
    codes: np.ndarray
    count: np.ndarray
    sim: np.ndarray

    def directions(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(own key, other key) of each pair, from both sides; a block with itself holds both already."""
        left, right = self.sums.left.ids()[self.codes >> HALF], self.sums.right.ids()[self.codes & LOW]
        yield left, right
        if not self.sums.same:
            yield right, left

    def of(self, own: np.ndarray, other: np.ndarray, turned: bool) -> np.ndarray:
        """Similarities by places; 0 for pairs that don't occur."""
        if not len(self.codes):
            return np.zeros(len(own))
        wanted = (other << HALF | own) if turned else (own << HALF | other)
        at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        return np.where((self.codes[at] == wanted) & (own >= 0) & (other >= 0), self.sim[at], 0.0)


def _combinations(dim_l: np.ndarray, dim_r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (left, right) with equal dimension, a bounded number at a time; both sides are sorted."""
    start = np.searchsorted(dim_r, dim_l, "left")
    size = np.searchsorted(dim_r, dim_l, "right") - start
    ends = np.cumsum(size)
    first = 0
    while first < len(dim_l):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + EXPAND, "right")))
        a = np.repeat(np.arange(first, last), size[first:last])
        offset = np.arange(len(a)) - np.repeat(ends[first:last] - size[first:last] - done, size[first:last])
        yield a, np.repeat(start[first:last], size[first:last]) + offset
        first = last


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """Cut the sorted stream into (unit, phase, rows) such that no dimension is cut."""
    names = ("pair", "phase", "dim", "side", "key", "val")
    carry = None
    for batch in batches:
        size = batch.column("keys").value_lengths().to_numpy(zero_copy_only=False)
        rows = {n: np.repeat(batch.column(n).to_numpy(zero_copy_only=False), size) for n in names[:4]}
        rows |= {n: batch.column(f"{n}s").flatten().to_numpy(zero_copy_only=False) for n in names[4:]}
        if carry is not None:
            rows = {n: np.concatenate([carry[n], rows[n]]) for n in names}
        unit = (np.diff(rows["pair"]) != 0) | (np.diff(rows["phase"]) != 0)
        cuts = np.flatnonzero(unit | (np.diff(rows["dim"]) != 0)) + 1
        ready = int(cuts[-1]) if len(cuts) else 0
        carry = {n: a[ready:] for n, a in rows.items()}
        yield from _units({n: a[:ready] for n, a in rows.items()}, np.flatnonzero(unit) + 1)
    if carry is not None:
        yield from _units(carry, np.empty(0, dtype=int))


def _units(rows: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    total = len(rows["dim"])
    edges = [0, *[int(c) for c in cuts if c < total], total]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(rows["pair"][a]), int(rows["phase"][a]), {n: v[a:b] for n, v in rows.items()}


def _sides(rows):
    return [{n: rows[n][rows["side"] == s] for n in ("dim", "key", "val")} for s in (0, 1)]


class _Met:
    """Distinct keys of one side of a unit, in order."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys, first, self.places = np.unique(keys, return_index=True, return_inverse=True)
        self.weights = weights[first]

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def ids(self) -> np.ndarray:
        return self.keys


class _ListSums(_PairSums):
    """Sums over shared dimensions for the keys of a block and all keys they meet."""

    def __init__(self, plan: BlockPlan, parts: list[dict[str, np.ndarray]]):
        super().__init__(plan, True)
        rows = {n: np.concatenate([p[n] for p in parts] or [np.empty(0, np.int64)]) for n in LIST_NAMES}
        self.left, self.right = _Met(rows["keys"], rows["vals"]), _Met(rows["others"], rows["other_vals"])
        li, ri = self.left.places, self.right.places
        for a, b in _meetings(rows):
            apart = rows["keys"][a] != rows["others"][b]
            a, b = a[apart], b[apart]
            x, y = rows["vals"][a].astype(float), rows["other_vals"][b].astype(float)
            self.parts.append(_summed(li[a] << HALF | ri[b], self._terms(x, y)))
            self.held += len(self.parts[-1][0])
            if self.held > max(EXPAND, 2 * self.settled):
                self._merge()


def _meetings(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (key, other) of the entries of each row, a bounded number at a time; no key's entries are cut."""
    size = np.repeat(rows["n_others"], rows["n_keys"])
    start = np.repeat(np.cumsum(rows["n_others"]) - rows["n_others"], rows["n_keys"])
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + EXPAND, "right")))
        a = np.repeat(np.arange(first, last), size[first:last])
        offset = np.arange(len(a)) - np.repeat(ends[first:last] - size[first:last] - done, size[first:last])
        yield a, np.repeat(start[first:last], size[first:last]) + offset
        first = last


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """Runs of rows of one (unit, phase) inside a batch."""
    for batch in batches:
        unit, phase = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("unit", "phase"))
        cuts = np.flatnonzero((np.diff(unit) != 0) | (np.diff(phase) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)]):
            if b == a:
                continue
            part = batch.slice(a, b - a)
            rows = {n: part.column(n).flatten().to_numpy(zero_copy_only=False) for n in LIST_NAMES[:4]}
            rows |= {f"n_{n}": part.column(n).value_lengths().to_numpy(zero_copy_only=False) for n in ("keys", "others")}
            rows["dim"] = np.repeat(part.column("dim").to_numpy(zero_copy_only=False), rows["n_keys"])
            yield int(unit[a]), int(phase[a]), rows


def _table(**columns) -> pa.RecordBatch:
    size = len(columns["key"])
    kinds = {n: np.float64 if n in ("sim", "val") else np.int64 for n in OUT_NAMES}
    arrays = [pa.array(np.asarray(columns.get(n, np.zeros(size)), dtype=kind)) for n, kind in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, OUT_NAMES)


def _first_k(group: np.ndarray, sim: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each group: similarity down, id up."""
    order = np.lexsort((other, -sim, group))
    sorted_group = group[order]
    starts = np.searchsorted(sorted_group, sorted_group, "left")
    return order[np.arange(len(order)) - starts < k]


def _reduce_keys(plan: BlockPlan, similar: _Similar) -> Iterator[pa.RecordBatch]:
    for own, other in similar.directions():
        if plan.reduce == "summary":
            order = np.argsort(own, kind="stable")
            keys, first = np.unique(own[order], return_index=True)
            if len(keys):
                count = similar.count[order]
                yield _table(
                    key=keys, neighbours=np.diff(np.append(first, len(own))), shared=np.add.reduceat(count, first),
                    best_shared=np.maximum.reduceat(count, first),
                )
        else:
            alike = np.flatnonzero(similar.sim > 0)
            keep = alike[_first_k(own[alike], similar.sim[alike], other[alike], plan.k)]
            yield _table(key=own[keep], other=other[keep], sim=similar.sim[keep], shared=similar.count[keep])


def _reduce_queries(plan: BlockPlan, similar: _Similar, asked, found, turned: bool) -> Iterator[pa.RecordBatch]:
    ends = (similar.sums.left, similar.sums.right)
    own, other = ends[turned].find(asked["key"]), ends[not turned].find(found["key"])
    for a, b in _combinations(asked["dim"], found["dim"]):
        values = similar.of(own[a], other[b], turned)
        if plan.reduce == "sum":
            total = np.bincount(a, weights=values, minlength=len(own))
            hit = np.flatnonzero(total != 0)
            yield _table(key=asked["key"][hit], dim=asked["dim"][hit], sim=total[hit])
            continue
        a, b, values = a[values > 0], b[values > 0], values[values > 0]
        keep = _first_k(a, values, found["key"][b], plan.k)
        a, b = a[keep], b[keep]
        yield _table(
            key=asked["key"][a], dim=asked["dim"][a], other=found["key"][b], sim=values[keep], val=found["val"][b]
        )


def _work(plan: BlockPlan):
    by_key = plan.reduce in ("summary", "neighbours")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, sums, similar = None, None, None
        for unit, phase, rows in _chunks(batches):
            if unit != pair:
                if sums is not None and by_key:
                    yield from _reduce_keys(plan, sums.finish())
                pair, sums, similar = unit, _PairSums(plan, unit >> HALF == unit & LOW), None
            left, right = _sides(rows)
            if phase == FACTS:
                sums.add(left, left if sums.same else right)
                continue
            if similar is None:
                similar = sums.finish()
            yield from _reduce_queries(plan, similar, left, right, phase == TURNED)
        if sums is not None and by_key:
            yield from _reduce_keys(plan, sums.finish())

    return run


def _reduce_asked(plan: BlockPlan, similar: _Similar, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    own, other = similar.sums.left.find(rows["keys"]), similar.sums.right.find(rows["others"])
    for a, b in _meetings(rows):
        values = similar.of(own[a], other[b], False)
        if plan.reduce == "sum":
            yield _weighted(rows, a, values)
            continue
        a, b, values = a[values > 0], b[values > 0], values[values > 0]
        keep = _first_k(a, values, rows["others"][b], plan.k)
        a, b, values = a[keep], b[keep], values[keep]
        if plan.reduce == "mean":
            yield _weighted(rows, a, values, rows["other_vals"][b])
        else:
            yield _table(key=rows["keys"][a], dim=rows["dim"][a], other=rows["others"][b], sim=values, val=rows["other_vals"][b])


def _weighted(rows: dict[str, np.ndarray], asked: np.ndarray, sim: np.ndarray, val: np.ndarray | None = None) -> pa.RecordBatch:
    """Per asking entry the sum of its similarities, and of the values weighted by them."""
    if not len(asked):
        return _table(key=[])
    low, size = int(asked.min()), int(asked.max() - asked.min()) + 1
    total = np.bincount(asked - low, weights=sim, minlength=size)
    weighted = total if val is None else np.bincount(asked - low, weights=sim * val, minlength=size)
    hit = np.flatnonzero(total != 0)
    return _table(key=rows["keys"][low + hit], dim=rows["dim"][low + hit], sim=total[hit], val=weighted[hit])


def _list_work(plan: BlockPlan):
    by_key = plan.reduce in ("summary", "neighbours")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, similar = None, [], None
        for unit, phase, rows in _stretches(batches):
            if unit != at:
                if by_key and held:
                    yield from _reduce_keys(plan, _ListSums(plan, held).finish())
                at, held, similar = unit, [], None
            if phase == FACTS:
                held.append(rows)
                continue
            if similar is None:
                similar, held = _ListSums(plan, held).finish(), []
            yield from _reduce_asked(plan, similar, rows)
        if by_key and held:
            yield from _reduce_keys(plan, _ListSums(plan, held).finish())

    return run


def _packed(df: DataFrame, blocks: Column) -> DataFrame:
    """Ratings gathered per (dimension, key block): at most one block of keys per row."""
    own = F.pmod(F.xxhash64("key"), F.col("_m"))
    rows = df.select("key", "dim", F.col("val").cast("double").alias("val"), blocks.alias("_m")).withColumn("_own", own)
    gathered = rows.groupBy("dim", "_own").agg(F.collect_list(F.struct("key", "val")).alias("kv"))
    return gathered.select("dim", "_own", F.col("kv.key").alias("keys"), F.col("kv.val").alias("vals"))


def _directory(packed: DataFrame) -> DataFrame:
    """The blocks that hold a dimension: at most as many as there are."""
    return packed.groupBy("dim").agg(F.collect_set("_own").alias("_blocks"))


def _routed(packed: DataFrame, directory: DataFrame, phase: Column, side: Column) -> DataFrame:
    """Packed rows, once for each block of the directory that their dimension is also in."""
    own, other = F.col("_own"), F.col("_other")
    copies = packed.join(directory, "dim").select("dim", "_own", "keys", "vals", F.explode("_blocks").alias("_other"))
    unit = F.shiftleft(F.least(own, other), HALF).bitwiseOR(F.greatest(own, other))
    return copies.select(unit.alias("pair"), phase.alias("phase"), "dim", side.alias("side"), "keys", "vals")


def routed_rows(facts: DataFrame, plan: BlockPlan, queries: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(pair, phase, dim, side, keys, vals): every packed row at the block pairs that share its dimension."""
    blocks = facts.agg(F.greatest(F.ceil(F.count_distinct("key") / plan.block), F.lit(1)).cast("long")).scalar()
    own, other = F.col("_own"), F.col("_other")
    packed = _packed(facts, blocks)
    rows = _routed(packed, _directory(packed), F.lit(FACTS), (own > other).cast("int"))
    if queries is not None:
        asked, found = _packed(queries, blocks), _packed(candidates, blocks)
        # A query's block is the unit's left one unless its number is the greater.
        rows = rows.unionByName(_routed(asked, _directory(found), F.when(own > other, TURNED).otherwise(STRAIGHT), F.lit(0)))
        rows = rows.unionByName(_routed(found, _directory(asked), F.when(other > own, TURNED).otherwise(STRAIGHT), F.lit(1)))
    return rows


def _known(df: DataFrame) -> DataFrame:
    """Rows that can meet others: a missing key or dimension equals nothing."""
    return df.where("key IS NOT NULL AND dim IS NOT NULL")


def _loads(rows: DataFrame, lists: DataFrame) -> Row:
    """Keys of ``rows`` and the entries of ``lists`` in their dimensions: of all, of the busiest key, of the longest list."""
    sizes = lists.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    met = rows.select("key", "dim").join(sizes, "dim").groupBy("key").agg(F.sum("n").alias("met"), F.max("n").alias("longest"))
    zero = F.lit(0).cast("long")
    with cleaned(rows.sparkSession):
        return met.agg(
            F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("met"), zero).alias("pairs"),
            F.coalesce(F.max("met"), zero).alias("most"), F.coalesce(F.max("longest"), zero).alias("longest"),
        ).first()


def _few_pairs(met: Row, asked: Row | None) -> bool:
    few = met.pairs <= MEAN_PAIRS * met.keys and met.most <= MOST_PAIRS
    return few and (asked is None or asked.longest <= PIECE)


def _lists(df: DataFrame, narrow: Row) -> DataFrame:
    """All keys and values of each dimension, at most PIECE in a row."""
    key = F.col("key").cast("int" if narrow.keys else "long").alias("key")
    val = F.col("val").cast("float" if narrow.vals else "double").alias("val")
    gathered = df.groupBy("dim").agg(F.collect_list(F.struct(key, val)).alias("kv"))
    starts = F.sequence(F.lit(1), F.size("kv"), F.lit(PIECE))
    pieces = gathered.select("dim", F.explode(F.transform(starts, lambda i: F.slice("kv", i, PIECE))).alias("kv"))
    return pieces.select("dim", F.col("kv.key").alias("others"), F.col("kv.val").alias("other_vals"))


def _narrow(df: DataFrame) -> Row:
    """Whether 32-bit numbers hold all keys and all values without a change."""
    val = F.col("val").cast("double")
    with cleaned(df.sparkSession):
        return df.agg(
            (F.coalesce(F.max(F.abs("key")), F.lit(0)) < 2**31).alias("keys"),
            (F.count_if(val.cast("float").cast("double") != val) == 0).alias("vals"),
        ).first()


def _met(own: DataFrame, lists: DataFrame, blocks: int, phase: int, part: tuple[int, int]) -> DataFrame:
    """The packed rows of the blocks of one pass, next to their lists."""
    packed = _packed(own, F.lit(blocks)).withColumnRenamed("_own", "unit")
    if part[1] > 1:
        packed = packed.where(F.pmod("unit", F.lit(part[1])) == part[0])
    return packed.join(lists, "dim").select("unit", F.lit(phase).alias("phase"), "dim", *LIST_NAMES[:4])


def _layout(plan: BlockPlan, met: Row, asked: Row | None) -> tuple[int, int, int]:
    """Blocks of keys, copies of each unit and passes over the units."""
    blocks = max(1, -(-met.keys // plan.block), -(-met.pairs // UNIT_PAIRS))
    copies = 1 if asked is None else max(1, min(-(-asked.most // ASKED_PAIRS), asked.pairs // max(1, met.pairs)))
    pairs = met.pairs * copies + (0 if asked is None else asked.pairs)
    return blocks, copies, max(1, min(blocks, -(-pairs // PASS_PAIRS)))


def whole_lists(facts: DataFrame, candidates: DataFrame | None = None) -> list[DataFrame]:
    """The lists of the facts, and of the candidates if there are any."""
    sources = facts.select("key", "val")
    narrow = _narrow(sources if candidates is None else sources.unionByName(candidates.select("key", "val")))
    return [_lists(df, narrow) for df in (facts, candidates) if df is not None]


def list_rows(facts: DataFrame, own: DataFrame, plan: BlockPlan, met: Row, queries: DataFrame | None = None,
              candidates: DataFrame | None = None, asked: Row | None = None, lists: list[DataFrame] | None = None,
              part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(unit, phase, dim, keys, vals, others, other_vals): a block's keys of a dimension, next to the dimension's list.

    Where a key asks for very much, units are copied and the queries dealt to the copies by dimension, while the facts
    copied stay fewer than the combinations asked for. ``part`` names one of several passes over the units.
    """
    blocks, copies, _ = _layout(plan, met, asked)
    lists = lists or whole_lists(facts, candidates)
    known = _met(own, lists[0], blocks, FACTS, part)
    if queries is None:
        return known
    wanted = _met(queries, lists[1], blocks, STRAIGHT, part)
    if copies > 1:
        known = known.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        wanted = wanted.withColumn("_copy", F.pmod(F.xxhash64("dim"), F.lit(copies)))
        known, wanted = (df.withColumn("unit", F.col("unit") * copies + F.col("_copy")).drop("_copy") for df in (known, wanted))
    return known.unionByName(wanted)


def _reduced(facts: DataFrame, plan: BlockPlan, queries: DataFrame | None, candidates: DataFrame | None,
             listed: BlockPlan) -> tuple[DataFrame, bool]:
    """What the units return, and whether they held whole lists and so worked by ``listed``.

    Whole lists are worked on in passes; the results of each are written, and its shuffle files removed, before the next.
    """
    facts, queries, candidates = (df if df is None else _known(df) for df in (facts, queries, candidates))
    if plan.reduce == "summary":  # only counts pairs
        facts = facts.withColumn("val", F.lit(0.0))
    own = facts if queries is None else facts.join(queries.select("key").distinct(), "key", "left_semi")
    met, asked = _loads(own, facts), None if queries is None else _loads(queries, candidates)
    parts = SPREAD * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if _few_pairs(met, asked):
        passes, lists = _layout(plan, met, asked)[2], whole_lists(facts, candidates)
        if passes > 1:  # every pass reads them
            lists = [durable(df, "lists") for df in lists]
        found = []
        for i in range(passes):
            rows = list_rows(facts, own, plan, met, queries, candidates, asked, lists, (i, passes))
            worked = rows.repartition(parts, "unit").sortWithinPartitions("unit", "phase").mapInArrow(_list_work(listed), OUT)
            found.append(worked if passes == 1 else durable(worked, "units"))
        return reduce(DataFrame.unionByName, found), True
    rows = routed_rows(facts, plan, queries, candidates)
    return rows.repartition(parts, "pair").sortWithinPartitions("pair", "phase", "dim").mapInArrow(_work(plan), OUT), False


def pair_statistics(facts: DataFrame, plan: BlockPlan, queries: DataFrame | None = None,
                    candidates: DataFrame | None = None) -> DataFrame:
    """Reduce similarities between keys of ``facts`` (key, dim, val).

    ``queries`` and ``candidates`` (same columns) ask, per query row, for the candidate keys of its dimension.
    Results of different units still have to be merged by the caller.
    """
    return _reduced(facts, plan, queries, candidates, plan)[0]


def weighted_means(facts: DataFrame, plan: BlockPlan, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per query (key, dim) the mean of its k most similar candidates' values, weighted by similarity."""
    found, whole = _reduced(facts, replace(plan, reduce="topk"), queries, candidates, replace(plan, reduce="mean"))
    sums = found
    if not whole:
        best = top_per_group(found, ["key", "dim"], [F.desc("sim"), F.asc("other")], plan.k)
        sums = best.withColumn("val", F.col("sim") * F.col("val"))
    return sums.groupBy("key", "dim").agg((F.sum("val") / F.sum("sim")).alias("mean"))
