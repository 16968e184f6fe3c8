"""Toxicity by a convolutional text classifier, trained here in numpy.

Words (letters, digits and all characters beyond ASCII) are embedded by hashing: the sum of a row for the word and
rows for its first 4 and 6 bytes, so that words of one stem share what is learned. Filters of one, two and three words
run over the whole text; each gives its largest value, and a logistic unit weighs these. Training takes one document
at a time with Adagrad; only the words behind a filter's maximum move. The first component of a row starts as the
log-odds of its documents' classes, the rest small and random.

Learning takes every labelled row whose crc32(doc_id as text) mod 4 is not 2. Rows are dealt by hash into shards of
about SHARD_ROWS rows or SHARD_BYTES bytes. In an epoch every shard trains a copy of the network in a task of its own;
then each of the network's numbers moves by the mean of the shards that moved it, and the next epoch starts there. A
quarter of the rows is held back from that and calibrates scores (a logistic fit) and the rejection threshold of each
language (best F1; languages with fewer than MIN_CLASS rows of a class there take the threshold of all); both come from
sums over all of these rows. Scores see texts alone.

Defined cases: null is an empty text and is scored like any other; rows of labels without a label are left out, of
several for one document the highest counts; without rows of both classes every score is 0; repeated documents are
scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratesift.llm.grouping import BROADCAST_IDS
from ratesift.llm.hashing import PUNCTUATION, U, Words, pieces
from ratesift.session import durable

SHARD_ROWS, SHARD_BYTES, MIN_CLASS = 8000, 64 << 20, 20
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 15, 8, 8, (1, 2, 3), (4, 6)
EPOCHS, RATE, WORD_DROP, SEED = 4, 0.1, 0.3, 11
PREDICT = 0.3
PACKED = ["shard", "ids", "toxic", "held", "lang"]
COLUMNS = sum(WIDTHS) * FILTERS
KINDS, PEAKS = 1 + len(PREFIXES), len(WIDTHS) * FILTERS
PARTS = {"rows": KINDS * BUCKETS, "filters": COLUMNS, "bias": PEAKS // DIM, "out": PEAKS // DIM, "offset": 1}  # rows of the table
UNIT = 1 << 24  # moves are summed in whole parts of this, so that their order does not matter


class Network:
    """Embeddings, filters and output weights, as parts of one table, and how logits become scores."""

    def __init__(self, table: np.ndarray, scale: tuple[float, float] = (1.0, 0.0)):
        self.table, self.scale = table, scale  # slope and offset of the calibration
        ends = np.cumsum(list(PARTS.values()))
        parts = dict(zip(PARTS, np.split(table, ends[:-1])))
        self.rows, self.filters = parts["rows"], parts["filters"].reshape(DIM, COLUMNS)
        self.bias, self.out = parts["bias"].reshape(-1), parts["out"].reshape(-1)
        self.offset = parts["offset"][0, :1]

    @classmethod
    def fresh(cls) -> "Network":
        rng = np.random.default_rng(SEED)
        net = cls(np.zeros((sum(PARTS.values()), DIM), np.float32))
        net.rows[:] = rng.normal(0, 0.01, net.rows.shape)
        net.filters[:] = rng.normal(0, 0.3, net.filters.shape)
        net.filters[0] = np.abs(net.filters[0]) + 0.3
        net.out[:], net.offset[:] = 0.2, -1
        return net

    def dump(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, table=self.table, scale=np.array(self.scale))
        return held.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Network":
        held = np.load(io.BytesIO(data))
        return cls(held["table"], tuple(held["scale"]))

    def responses(self, vectors: np.ndarray, n: int) -> list[np.ndarray]:
        """Each width's filters at n places; vectors are padded with zeros."""
        all_, at, out = vectors @ self.filters, 0, []
        for w in WIDTHS:
            total = all_[:n, at: at + FILTERS].copy()
            for j in range(1, w):
                total += all_[j: n + j, at + j * FILTERS: at + (j + 1) * FILTERS]
            out.append(total)
            at += w * FILTERS
        return out

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Logits of consecutive texts; a gap of zero vectors follows each, so that no filter sees two."""
        gap = max(WIDTHS) - 1
        count = np.diff(bounds)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(count)) * (gap + 1), count)
        vectors = np.zeros((len(ids) + (gap + 1) * len(count) + gap, DIM), np.float32)
        vectors[place] = self.rows[ids].sum(axis=1)
        starts = bounds[:-1] + np.arange(len(count)) * (gap + 1)
        peaks = [np.maximum.reduceat(r, starts, axis=0) for r in self.responses(vectors, len(vectors) - gap)]
        return np.maximum(np.concatenate(peaks, axis=1) + self.bias, 0) @ self.out + float(self.offset[0])

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -30, 30)))


def word_ids(words: Words) -> np.ndarray:
    """Rows of the embedding for every word: its own and its prefixes'."""
    kinds = [words.hashes, *words.prefixes]
    return np.stack([(h % U(BUCKETS)).astype(np.int32) + i * BUCKETS for i, h in enumerate(kinds)], axis=1)


def text_ids(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, _, data, offsets in pieces(column):
        words = Words(data, offsets, PUNCTUATION, PREFIXES)
        yield row, word_ids(words), words.bounds


class Adagrad:
    def __init__(self, values: np.ndarray, seen: np.ndarray):
        self.values, self.seen = values, seen

    def step(self, gradient: np.ndarray, at=slice(None)) -> None:
        self.seen[at] += gradient**2
        self.values[at] -= RATE * gradient / np.sqrt(self.seen[at])


def train(net: Network, seen: Network, docs: Sequence[np.ndarray], labels: Sequence[int], weights: dict[int, float], rng: np.random.Generator) -> None:
    """One epoch over ``docs``; ``seen`` holds Adagrad's sums in the places of the network's numbers."""
    rows, filters, bias, out, offset = (Adagrad(getattr(net, part), getattr(seen, part)) for part in PARTS)
    gap = max(WIDTHS) - 1
    for d in rng.permutation(len(docs)):
        ids = places(docs[d])
        keep = np.ones(ids.shape, np.float32)
        keep[:, 0] = rng.random(len(ids)) >= WORD_DROP
        vectors = np.zeros((len(ids) + 1 + gap, DIM), np.float32)
        vectors[: len(ids)] = (net.rows[ids] * keep[:, :, None]).sum(axis=1)
        found = net.responses(vectors, len(ids) + 1)
        peaks = np.concatenate([r.argmax(axis=0) for r in found])
        value = np.concatenate([r.max(axis=0) for r in found]) + net.bias
        on = np.maximum(value, 0)
        error = (1 / (1 + np.exp(-np.clip(on @ net.out + net.offset[0], -30, 30))) - labels[d]) * weights[labels[d]]
        back = (error * net.out * (value > 0)).astype(np.float32)
        out.step((error * on).astype(np.float32))
        bias.step(back)
        offset.step(np.array([error], np.float32))
        to_vectors, to_filters, column = np.zeros_like(vectors), np.zeros_like(net.filters), 0
        for i, w in enumerate(WIDTHS):
            part = slice(i * FILTERS, (i + 1) * FILTERS)
            for j in range(w):
                here = slice(column, column + FILTERS)
                np.add.at(to_vectors, peaks[part] + j, back[part, None] * net.filters[:, here].T)
                to_filters[:, here] = vectors[peaks[part] + j].T * back[part]
                column += FILTERS
        filters.step(to_filters)
        touched = np.unique(np.concatenate([peaks + j for j in range(max(WIDTHS))]))
        touched = touched[touched < len(ids)]
        if len(touched):
            moved, which = np.unique(ids[touched], return_inverse=True)
            gradient = np.zeros((len(moved), DIM), np.float32)
            np.add.at(gradient, which.reshape(-1), (to_vectors[touched][:, None, :] * keep[touched][:, :, None]).reshape(-1, DIM))
            rows.step(gradient, moved)


def places(ids: np.ndarray) -> np.ndarray:
    """Rows of the embedding from the 16 bits that are kept of each."""
    return ids + np.arange(KINDS, dtype=np.int32) * BUCKETS


def _packed(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, ids, toxic, held, lang): a row for each of ``rows`` (label_id, text, lang, toxic, held), its text as places.

    A shard's rows follow each other in one partition, ordered by label_id and text.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found, bounds in text_ids(batch["text"]):
                own = batch.slice(row, len(bounds) - 1)
                data = (found - np.arange(KINDS, dtype=np.int32) * BUCKETS).astype(np.uint16)
                ends = (bounds * data[:1].nbytes).astype(np.int32)
                ids = pa.BinaryArray.from_buffers(pa.binary(), own.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.record_batch([own["shard"], ids, own["toxic"], own["held"], own["lang"].cast(pa.string())], names=PACKED)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "label_id", "text"), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "label_id", "text")
    return dealt.select("shard", "text", "toxic", "held", "lang").mapInArrow(
        pack, "shard int, ids binary, toxic int, held boolean, lang string"
    )


def _rows(batches: Iterator[pa.RecordBatch], side: bool | None) -> Iterator[tuple[int, np.ndarray, int, str | None]]:
    """(shard, ids, label, language) of the rows that are held back, or aren't, or of all if ``side`` is None."""
    for batch in batches:
        shard, toxic, held, lang = (batch[c].to_pylist() for c in ("shard", "toxic", "held", "lang"))
        for r, ids in enumerate(batch["ids"]):
            if side is None or held[r] == side:
                yield shard[r], np.frombuffer(ids.as_buffer(), np.uint16).reshape(-1, KINDS), toxic[r], lang[r]


def _start(net: Network, packed: DataFrame, side: bool | None) -> None:
    """First components from smoothed log-odds of document counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(net.rows)), np.int64)
        for _, ids, y, _ in _rows(batches, side):
            counts[y, np.unique(places(ids))] += 1
        y, place = np.nonzero(counts)
        yield pa.record_batch([pa.array(place), pa.array(y), pa.array(counts[y, place])], names=["place", "toxic", "n"])

    found = packed.mapInArrow(count, "place long, toxic long, n long").groupBy("place", "toxic").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, len(net.rows)), np.float32)
    counts[found["toxic"].to_numpy(), found["place"].to_numpy()] = found["n"].to_numpy()
    share = counts[0].sum() / max(counts[1].sum(), 1)
    net.rows[:, 0] += 0.3 * np.log((counts[1] * max(share, 1) + 1) / (counts[0] + 1)).clip(-3, 6)


def fit(packed: DataFrame, weights: dict[int, float], side: bool | None) -> Network:
    """Epochs over all shards; what leaves a task are the moved rows of the network's table."""
    net = Network.fresh()
    _start(net, packed, side)
    state = np.concatenate([net.table, np.full_like(net.table, 1e-2)], axis=1)
    names = [f"m{i}" for i in range(2 * DIM)]
    for epoch in range(EPOCHS):
        def run(batches: Iterator[pa.RecordBatch], state=state, epoch=epoch) -> Iterator[pa.RecordBatch]:
            for shard, rows in groupby(_rows(batches, side), key=itemgetter(0)):
                _, docs, labels, _ = zip(*rows)
                values, seen = state[:, :DIM].copy(), state[:, DIM:].copy()
                train(Network(values), Network(seen), docs, labels, weights, np.random.default_rng([SEED, epoch, shard]))
                moves = np.concatenate([values, seen], axis=1) - state
                at = np.flatnonzero(moves.any(axis=1))
                steps = np.rint(moves[at].astype(float) * UNIT).astype(np.int64)
                yield pa.record_batch([pa.array(at), *(pa.array(c) for c in steps.T.copy())], names=["place", *names])

        moved = packed.mapInArrow(run, "place long, " + ", ".join(f"{n} long" for n in names))
        found = moved.groupBy("place").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).toArrow()
        steps = np.stack([found[n].to_numpy() for n in names], axis=1) / found["n"].to_numpy()[:, None] / UNIT
        state = state.copy()
        state[found["place"].to_numpy()] += steps.astype(np.float32)
    return Network(np.ascontiguousarray(state[:, :DIM]))


def judged(packed: DataFrame, net: Network, side: bool | None) -> DataFrame:
    """(lang, toxic, logit) of the rows that calibrate."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, docs, labels, langs = zip(*found) if (found := list(_rows([batch], side))) else [()] * 4
            logits = [float(net.logits(places(ids), np.array([0, len(ids)]))[0]) for ids in docs]
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(labels, pa.int32()), pa.array(logits, pa.float64())], names=["lang", "toxic", "logit"])

    return packed.mapInArrow(judge, "lang string, toxic int, logit double")


def calibration(rows: DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps, with a small penalty on the slope."""
    a, b, x = 1.0, 0.0, F.col("logit")
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.least(x * a + b, F.lit(30.0)), F.lit(-30.0))))
        r, h = p - F.col("toxic"), F.greatest(p * (1 - p), F.lit(1e-6))
        gx, g, hxx, hx, hs = rows.agg(F.sum(r * x), F.sum(r), F.sum(h * x * x), F.sum(h * x), F.sum(h)).first()
        step = np.linalg.solve(np.array([[hxx + 0.1, hx], [hx, hs + 1e-3]]), np.array([gx + 0.1 * (a - 1), g]))
        a, b = a - float(np.clip(step[0], -0.5, 0.5)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def best_cuts(rows: DataFrame, net: Network) -> dict[str, float]:
    """By language ('' for all others) the middle of the gap between scores at which F1 is best.

    Rows are summed per logit, and running sums are taken per range of logits with the sums of the ranges ahead.
    """
    named = rows.select(F.explode(F.array_distinct(F.array(F.coalesce("lang", F.lit("")), F.lit("")))).alias("lang"), "logit", "toxic")
    steps = named.groupBy("lang", "logit").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    steps = durable(steps.withColumn("range", F.floor(F.col("logit") * 64)), "logits")
    sums = steps.groupBy("lang", "range").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))

    def ahead(c: str) -> Column:
        before = Window.partitionBy("lang").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    def upto(c: str) -> Column:
        return F.sum(c).over(Window.partitionBy("lang", "range").orderBy(F.desc("logit"))) + F.col(f"{c}_ahead")

    totals = sums.groupBy("lang").agg(F.sum("n").alias("rows"), F.sum("hits").alias("toxic"))
    totals = totals.where((F.col("lang") == "") | (F.least(F.col("toxic"), F.col("rows") - F.col("toxic")) >= MIN_CLASS))
    ranges = sums.select("lang", "range", ahead("n").alias("n_ahead"), ahead("hits").alias("hits_ahead")).join(totals, "lang")
    f1 = 2 * F.col("hits_upto") / (F.col("n_upto") + F.col("toxic"))
    scored = steps.join(ranges, ["lang", "range"]).withColumns({"hits_upto": upto("hits"), "n_upto": upto("n")}).withColumn("f1", f1)
    best = durable(scored.groupBy("lang").agg(F.max(F.struct("f1", "logit"))["logit"].alias("cut")), "cuts")
    below = steps.join(best, "lang").groupBy("lang").agg(F.first("cut").alias("cut"), F.max(F.when(F.col("logit") < F.col("cut"), F.col("logit"))).alias("next"))
    found = {}
    for r in below.collect():
        high, low = net.scores(np.array([r.cut, -np.inf if r.next is None else r.next]))
        found[r.lang] = float((high + (0.0 if r.next is None else low)) / 2)
    return found


def _key(name: str = "doc_id"):
    return F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[bytes, dict[str, float]] | None:
    """The network and thresholds by language ('' for all others) of all labelled rows; None without both classes."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    held = F.pmod(F.xxhash64(F.lit("check"), "label_id"), F.lit(4)) == 0
    known = durable(known.where(_key("label_id") % 4 != 2).withColumn("held", held), "known")
    few = F.broadcast(known) if known.count() <= BROADCAST_IDS else known

    def labelled(*columns: Column) -> DataFrame:
        rows = docs.where(_key() % 4 != 2).select("doc_id", *columns)
        return rows.join(few, F.col("doc_id") == F.col("label_id")).drop("doc_id")

    text = F.coalesce("text", F.lit(""))
    sizes = labelled(F.octet_length(text).alias("size")).groupBy("toxic", "held").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    if len({r.toxic for r in sizes}) < 2:
        return None
    apart = len(sizes) == 4  # both classes on both sides; otherwise too few rows to hold any back
    count = {y: sum(r.n for r in sizes if r.toxic == y and not (apart and r.held)) for y in (0, 1)}
    weights = {y: sum(count.values()) / (2 * n) for y, n in count.items()}
    shards = max(-(-sum(r.n for r in sizes) // SHARD_ROWS), -(-sum(r.size for r in sizes) // SHARD_BYTES))
    rows = labelled(text.alias("text"), F.col("lang").cast("string").alias("lang"))
    packed = _packed(rows, shards).persist(StorageLevel.DISK_ONLY)  # read once an epoch; keeps whole shards in their partitions
    net = fit(packed, weights, False if apart else None)
    checked = durable(judged(packed, net, True if apart else None), "judged")
    packed.unpersist()
    net.scale = calibration(checked)
    return net.dump(), best_cuts(checked, net)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, rejected) of every document."""
    learned = learn(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(learned[0]) if learned else None
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if net:
                for row, ids, bounds in text_ids(batch["text"]):
                    out[row: row + len(bounds) - 1] = net.scores(net.logits(ids, bounds))
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), batch["lang"].cast(pa.string()), pa.array(out)], names=["doc_id", "lang", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    scored = texts.mapInArrow(score, "doc_id long, lang string, score double")
    cuts = dict(learned[1]) if learned else {"": 1.0}
    threshold = F.lit(cuts.pop(""))
    for lang, cut in cuts.items():
        threshold = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(threshold)
    return scored.withColumn("threshold", threshold).select(
        "doc_id", (_key() % 4 == 2).alias("held_out"), "score",
        F.when(F.col("score") >= PREDICT, 1).otherwise(0).alias("predicted"),
        "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"),
    )
