"""SimHash near-duplicates by navigable small-world graphs over Hamming distance.

Signatures of 256 bits summarise the distinct runs of two words. Texts with the same words are one node.
Nodes are dealt to shards in several rounds, each time by the least hash of their runs of
three words under another hash function: texts of similarity s meet in a round with
probability s, in one of ROUNDS or more with 1 - (1 - s) ** ROUNDS. Nodes alone with their
hash sit that round out. So the work grows with the number of nodes, not with its square.
A shard that a frequent hash makes larger than ``shard_rows`` is cut into blocks that all
meet. A shard's graph has adjacency lists: each node's nearest ones of
those that stand beside it in 64 orders of the signatures (order t compares them turned
left by 4t bits), and a few links far away in one of the orders. A query enters beside its own place in each order and walks best
first: a beam holds the nearest nodes met, and the links of those not yet expanded are looked
at until all of the beam are. Each task audits the recall of a sample of its queries, by
query and by group, against exact search; beam and entries double until the target is met.

All pairs within the radius are candidates. Two edge-disjoint minimum spanning forests of
them are verified first, by the exact Jaccard similarity of runs of three words; then all
other candidates that would join different verified groups. So every candidate is verified
or lies within a verified group. Verified edges are united.

At last the groups are audited: a sample of nodes is compared exactly with all texts, and if
too few of the similar ones are in the same group, all is done again with a wider radius,
with every block of nodes sent to every other, or with a wider beam.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cleared, column, mark, removed, spare, table, texts_of, written
from quarry.llm.components import components, forest
from quarry.llm.text import U64, chunks, mix, shingles, words

#: Production parameters: Jaccard similarity, bits that may differ, nodes of a shard.
SIMILARITY, RADIUS, SHARD = 0.6, 72, 1 << 18
ORDERS, BEAM, AUDITED, RECALL = 64, 16, 512, 0.95
#: Rounds of dealing, and nodes that a shard of a round has on average.
ROUNDS, DEALT = 8, 1 << 14
#: Links of a node to near ones and to far ones, nodes of the beam expanded at once, and queries that walk at once.
NEAR, FAR, EXPANDED, WALKERS = 16, 4, 4, 8192
#: Direct links that tie a query to a large group, audited queries with partners wanted, and blocks of AUDITED to find them in.
ENOUGH_LINKS, QUERIES_SEEN, MOST_BLOCKS = 16, 256, 16
#: Nodes of a slice compared exactly with all texts, those with partners wanted, slices at most, and the widest radius.
SLICE, PARTNERED, SLICES, WIDEST = 4096, 64, 4, 96
#: Keys are broadcast up to this number of rows (some 50 bytes each), shuffled beyond it.
BROADCAST_ROWS = 500_000
_SIGNS = (((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2 - 1).astype(np.float32)
_SIGNATURE = ["s0", "s1", "s2", "s3"]
_LEAST = [f"k{r}" for r in range(ROUNDS)]


def signatures(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """256-bit SimHash of each text's distinct runs as four words; votes are counted by byte values."""
    n = len(offsets) - 1
    out = np.zeros((n, 32), np.uint8)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((runs, owner))
    owner, x = owner[order], runs[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    owner, x = owner[new] * 256, x[new]
    for word in range(4):
        x = mix(x + U64(0x9E3779B97F4A7C15)) if word else x
        values = x.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            votes = np.bincount(owner + values[:, b], minlength=n * 256).reshape(n, 256).astype(np.float32)
            out[:, word * 8 + b] = np.packbits(votes @ _SIGNS > 0, axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)


def identities(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's sequence of words."""
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros((len(offsets) - 1, 2), U64)
    for k in range(2):
        mixed = mix(hashes + mix(place.astype(U64) * U64(2 * k + 3) + U64(k)))
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(mixed, dtype=U64)))
        out[:, k] = mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U64))
    return out


def least_hashes(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text and round the least hash of its runs; 0 for a text without any."""
    out = np.zeros((len(offsets) - 1, ROUNDS), U64)
    some = np.diff(offsets) > 0
    for r in range(ROUNDS if some.any() else 0):
        out[some, r] = np.minimum.reduceat(mix(runs + U64(r + 1) * U64(0x9E3779B97F4A7C15)), offsets[:-1][some])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _summaries(keyed: DataFrame) -> DataFrame:
    """Key, node, signature and least hashes of each row whose text has words."""
    names = ["key", "n0", "n1", *_SIGNATURE, *_LEAST]

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            nodes, marks, least = [], [], []
            keep = np.zeros(len(texts), bool)
            for a, b in chunks(np.fromiter((len(t) for t in texts), np.int64, len(texts)), 1 << 18):
                hashes, offsets, _, _ = words(texts[a:b])
                nodes.append(identities(hashes, offsets))
                marks.append(signatures(*shingles(hashes, offsets, 2)))
                least.append(least_hashes(*shingles(hashes, offsets, 3)))
                keep[a:b] = np.diff(offsets) > 0
            if not keep.any():
                continue
            node, mark, low = (np.concatenate(x)[keep] for x in (nodes, marks, least))
            key = batch.column(0).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([key, *(_signed(x) for x in node.T), *(_signed(x) for x in mark.T), *(_signed(x) for x in low.T)], names=names)

    return keyed.select("key", "text").mapInArrow(run, "key binary, " + ", ".join(f"{n} bigint" for n in names[1:]))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a), np.int16)
    for k in range(4):
        total += np.bitwise_count(a[:, k] ^ b[:, k])
    return total


def _turned(s: np.ndarray, bits: int) -> np.ndarray:
    word, shift = divmod(bits, 64)
    left, right = s[:, word % 4], s[:, (word + 1) % 4]
    return left if not shift else (left << U64(shift)) | (right >> U64(64 - shift))


_FARTHEST = np.iinfo(np.int64).max


def _merged(best: np.ndarray, columns: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """The nearest of both, as many as ``best`` has, in its place: keys of distance, node and whether it isn't expanded yet."""
    for a in range(0, len(best), WALKERS):
        more = columns[a : a + WALKERS] if isinstance(columns, np.ndarray) else np.stack([c[a : a + WALKERS] for c in columns], axis=1)
        every = np.concatenate([best[a : a + WALKERS], more], axis=1)
        every.sort(axis=1)
        # Of a node's keys the expanded one comes first.
        every[:, 1:][(every[:, 1:] >> 1) == (every[:, :-1] >> 1)] = _FARTHEST
        every.sort(axis=1)
        best[a : a + WALKERS] = every[:, : best.shape[1]]
    return best


class Graph:
    """Adjacency lists over the signatures of a shard."""

    def __init__(self, marks: np.ndarray, radius: int, beam: int, links: int = NEAR, far: int = FAR):
        self.marks, self.radius, self.beam = marks, radius, beam
        self.reach = max(1, min(beam // 4, len(marks)))
        self.orders = np.empty((ORDERS, len(marks)), np.int32)
        for t in range(ORDERS):
            self.orders[t] = np.argsort(_turned(marks, t * (256 // ORDERS)))
        self.met: list[np.ndarray] = []
        self.own = self._beside_each(max(links, beam))
        near = self.own[:, :links]
        node = np.where(near == _FARTHEST, -1, (near >> 1) & 0xFFFFFFFF)
        self.links = np.concatenate([node, self._far(far)], axis=1).astype(np.int32)

    def _far(self, many: int) -> np.ndarray:
        """Links by powers of two along the first orders, so that every region leads to all others."""
        n = len(self.marks)
        out = np.full((n, many), -1, np.int64)
        rng = np.random.default_rng(n)
        for k in range(many):
            order = self.orders[k % ORDERS].astype(np.int64)
            step = 1 << rng.integers(0, max(1, n.bit_length() - 1), n)
            out[order, k] = order[(np.arange(n) + step) % n]
        return out

    def _note(self, node: np.ndarray, query: np.ndarray, many: int) -> None:
        self.met.append(node * many + query)

    def _beside_each(self, width: int) -> np.ndarray:
        """Keys of the nearest nodes beside each node in the orders; all pairs within the radius are noted."""
        n = len(self.marks)
        best, columns = np.full((n, width), _FARTHEST), []
        for t in range(ORDERS):
            order = self.orders[t].astype(np.int64)
            nodes = self.marks[order]
            for d in range(1, min(self.reach, n - 1) + 1):
                a, b, far = order[:-d], order[d:], _distance(nodes[:-d], nodes[d:]).astype(np.int64)
                hit = far <= self.radius
                self._note(np.minimum(a[hit], b[hit]), np.maximum(a[hit], b[hit]), n)
                for x, y in ((a, b), (b, a)):
                    column = np.full(n, _FARTHEST)
                    column[x] = far << 40 | y << 1 | 1
                    columns.append(column)
                if len(columns) >= 32:
                    best, columns = _merged(best, columns), []
            if t % 8 == 7 and self.met:
                self.met = [np.unique(np.concatenate(self.met))]
        return _merged(best, columns) if columns else best

    def _enter(self, queries: np.ndarray, first: int, many: int) -> np.ndarray:
        """Keys of the nodes beside the queries' places in all orders."""
        n = len(self.marks)
        best, columns = np.full((len(queries), self.beam), _FARTHEST), []
        for t in range(ORDERS):
            order = self.orders[t].astype(np.int64)
            place = np.searchsorted(_turned(self.marks, t * (256 // ORDERS))[order], _turned(queries, t * (256 // ORDERS)))
            for d in range(-self.reach, self.reach):
                at = place + d
                sound = (at >= 0) & (at < n)
                node = order[np.where(sound, at, 0)]
                far = _distance(self.marks[node], queries).astype(np.int64)
                hit = np.flatnonzero(sound & (far <= self.radius))
                self._note(node[hit], hit + first, many)
                columns.append(np.where(sound, far << 40 | node << 1 | 1, _FARTHEST))
                if len(columns) >= 32:
                    best, columns = _merged(best, columns), []
        return _merged(best, columns) if columns else best

    def _walk(self, queries: np.ndarray, best: np.ndarray, first: int, many: int) -> None:
        """Best-first beam search from the nodes of ``best``; pairs within the radius are noted."""
        live = np.arange(len(queries))
        while len(live):
            keys = best[live]
            fresh = (keys & 1 == 1) & (keys != _FARTHEST)
            pick = fresh & (np.cumsum(fresh, axis=1) <= EXPANDED)
            going = pick.any(axis=1)
            live, keys, pick = live[going], keys[going], pick[going]
            if not len(live):
                break
            row, at = np.nonzero(pick)
            node = self.links[(keys[row, at] >> 1) & 0xFFFFFFFF].astype(np.int64)
            keys[row, at] &= ~1
            far = np.bitwise_count(self.marks[np.maximum(node, 0)] ^ queries[live[row], None]).sum(axis=2, dtype=np.int64)
            hit = np.nonzero((node >= 0) & (far <= self.radius))
            self._note(node[hit], live[row[hit[0]]] + first, many)
            # The expanded nodes' links side by side, up to EXPANDED of them in a row.
            more = np.full((len(live), EXPANDED, node.shape[1]), _FARTHEST)
            more[row, np.arange(len(row)) - np.searchsorted(row, row)] = np.where(node >= 0, far << 40 | node << 1 | 1, _FARTHEST)
            best[live] = _merged(keys, more.reshape(len(live), -1))

    def pairs(self, queries: np.ndarray | None) -> np.ndarray:
        """Pairs (node, query) within the radius that are met; queries None: the nodes themselves, each pair once."""
        asked = self.marks if queries is None else queries
        many = len(asked)
        if queries is not None:
            self.met = []
        for a in range(0, many, WALKERS):
            part = asked[a : a + WALKERS]
            start = self.own[a : a + WALKERS, : self.beam].copy() if queries is None else self._enter(part, a, many)
            self._walk(part, start, a, many)
            if len(self.met) > 64:
                self.met = [np.unique(np.concatenate(self.met))]
        met = np.unique(np.concatenate(self.met)) if self.met else np.zeros(0, np.int64)
        self.met = []
        node, query = met // max(many, 1), met % max(many, 1)
        if queries is None:
            met = np.unique(np.minimum(node, query)[node != query] * many + np.maximum(node, query)[node != query])
            node, query = met // max(many, 1), met % max(many, 1)
        return np.stack([node, query], axis=1)


def exact_pairs(graph: np.ndarray, queries: np.ndarray, chosen: np.ndarray, radius: int) -> np.ndarray:
    """Pairs (node, query) within the radius for the chosen queries, by comparing with all nodes."""
    out = [np.stack([hit, np.full(len(hit), q)], axis=1) for q in chosen.tolist() if len(hit := np.flatnonzero(_distance(graph, queries[q : q + 1]) <= radius))]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _shares(truth: np.ndarray, pairs: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query with partners: their number, and the share met directly (ENOUGH_LINKS of them count as all)."""
    partners = np.bincount(truth[:, 1], minlength=many)
    met = np.bincount(truth[np.isin(truth @ (many, 1), pairs @ (many, 1)), 1], minlength=many)
    asked = np.flatnonzero(partners)
    return partners[asked], np.minimum(1.0, met[asked] / np.minimum(partners[asked], ENOUGH_LINKS))


def search(graph: np.ndarray, queries: np.ndarray | None, radius: int = RADIUS, beam: int = BEAM, audited: int = AUDITED, recall: float = RECALL) -> tuple[np.ndarray, float, int]:
    """Pairs found, recall audited, and the beam that it took.

    Queries are audited in random order until QUERIES_SEEN with few partners are seen. Only
    pairs met directly count, not chains, which verification may cut. The recall is the
    lesser of its means by query and by group (queries weighted by one over their partners),
    so that no hot group outvotes the others. Where few queries have partners, probes count
    too: copies of nodes with between half the radius and the radius of their bits turned.
    """
    asked = graph if queries is None else queries
    if not len(graph) or not len(asked):
        return np.zeros((0, 2), np.int64), 1.0, beam
    rng = np.random.default_rng(len(asked))
    shuffled = rng.permutation(len(asked))
    truths, seen, at = [], 0, 0
    while at < len(asked) and seen < QUERIES_SEEN and at < audited * MOST_BLOCKS:
        chosen = shuffled[at : at + audited]
        part = exact_pairs(graph, asked, chosen, radius)
        if queries is None:
            part = part[part[:, 0] != part[:, 1]]
        partners = np.bincount(part[:, 1], minlength=1)
        seen += int(((partners > 0) & (partners <= ENOUGH_LINKS)).sum())
        truths.append(part)
        at += len(chosen)
    truth = np.concatenate(truths)
    sample, own = np.unique(truth[:, 1], return_inverse=True)
    truth = np.stack([truth[:, 0], own], axis=1)
    probes = np.zeros((0, 4), U64)
    if seen < QUERIES_SEEN and at < len(asked):
        base = rng.integers(0, len(graph), QUERIES_SEEN - seen)
        turned = np.argsort(rng.random((len(base), 256)), axis=1).argsort(axis=1) < rng.integers(radius // 2, radius + 1, len(base))[:, None]
        probes = graph[base] ^ np.packbits(turned, axis=1).view(U64)
        truth = np.concatenate([truth, np.stack([base, len(sample) + np.arange(len(base))], axis=1)])
    trial = np.concatenate([asked[sample], probes])
    while True:
        made = Graph(graph, radius, beam)
        own = made.met
        partners, share = _shares(truth, made.pairs(trial), max(1, len(trial)))
        got = min(share.mean(), np.average(share, weights=1 / partners)) if len(share) else 1.0
        if got >= recall or beam >= 4 * len(graph):
            made.met = own
            return made.pairs(queries), float(got), beam
        del made, own
        beam *= 2


def _dealt(nodes: DataFrame, shard_rows: int) -> DataFrame:
    """Nodes with the number of each shard that they go to; those alone with their least hash in a round are left out of it."""
    rounds = nodes.select("n0", "n1", *_SIGNATURE, F.posexplode(F.array(*_LEAST)).alias("round", "least"))
    alike = rounds.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("round", "least"))).filter("many > 1")
    rows = written(alike.drop("many"), "dealt")
    shards = max(1, -(-rows.count() // (ROUNDS * min(shard_rows, DEALT))))
    return rows.withColumn("shard", (F.col("round") * shards + F.pmod(F.xxhash64("least"), F.lit(shards))).cast("int"))


def _candidates(nodes: DataFrame, count: int, radius: int, shard_rows: int, beam: int = BEAM, every: bool = False) -> DataFrame:
    """Pairs of nodes within the radius: (a, b, part), part 1 or 2: in that spanning forest of its task, 0: in neither, -1: not a pair but the task's audit.

    A pair has the lesser node first; several tasks may find it. every: all nodes are one shard.
    """
    if every or count <= min(shard_rows, DEALT):
        sent, large = nodes.withColumn("shard", F.lit(0)), [(0, count)] if count > shard_rows else []
    else:
        sent = _dealt(nodes, shard_rows)
        large = [tuple(r) for r in sent.groupBy("shard").count().filter(F.col("count") > 2 * shard_rows).collect()]
    # Block i of a large shard goes to the tasks (i, j) and (j, i), i <= j: queries of i against the graph of j.
    cut = {int(shard): -(-rows // shard_rows) for shard, rows in large}
    many = F.coalesce(F.create_map(*[F.lit(x) for item in cut.items() for x in item])[F.col("shard")], F.lit(1)) if cut else F.lit(1)
    blocks = sent.withColumn("blocks", many).withColumn("block", F.pmod(F.xxhash64("n0", "n1"), F.col("blocks")).cast("int"))
    sent = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n0", "ascending"), ("n1", "ascending")])
        block = group["block"].to_numpy()
        shard, low, high = (int(group[c][0].as_py()) for c in ("shard", "low", "high"))
        name = np.stack([group["n0"].to_numpy(), group["n1"].to_numpy()], axis=1)
        mark = np.stack([group[s].to_numpy() for s in _SIGNATURE], axis=1).view(np.uint64)
        if low == high:
            pairs, recall, beam_used = search(mark, None, radius, beam)
        else:
            asks, holds = np.flatnonzero(block == low), np.flatnonzero(block == high)
            pairs, recall, beam_used = search(mark[holds], mark[asks], radius, beam)
            pairs = np.stack([holds[pairs[:, 0]], asks[pairs[:, 1]]], axis=1)
        a, b = pairs.min(axis=1), pairs.max(axis=1)
        part = np.zeros(len(a), np.int32)
        weight = _distance(mark[a], mark[b])
        for k in (1, 2):
            rest = np.flatnonzero(part == 0)
            part[rest[forest(len(name), a[rest], b[rest], weight[rest])]] = k
        # The last row is the task's audit: recall in millionths, the beam, the shard, and its blocks.
        arrays = [np.append(x, y) for x, y in zip((name[a, 0], name[a, 1], name[b, 0], name[b, 1], part), (int(recall * 1e6), beam_used, shard, low << 32 | high, -1), strict=True)]
        return pa.table([*(pa.array(x, pa.int64()) for x in arrays[:4]), pa.array(arrays[4], pa.int32())], names=["a0", "a1", "b0", "b1", "part"])

    flat = sent.select("shard", "low", "high", "block", "n0", "n1", *_SIGNATURE).groupBy("shard", "low", "high").applyInArrow(run, "a0 bigint, a1 bigint, b0 bigint, b1 bigint, part int")
    return flat.select(F.struct(F.col("a0").alias("n0"), F.col("a1").alias("n1")).alias("a"), F.struct(F.col("b0").alias("n0"), F.col("b1").alias("n1")).alias("b"), "part")


def _runs(texts: DataFrame) -> DataFrame:
    """(node, runs): the set of hashed runs of three words of each text."""

    def run(batches):
        for batch in batches:
            rows = texts_of(batch, "text")
            for a, b in chunks(np.fromiter((len(t) for t in rows), np.int64, len(rows)), 1 << 20):
                hashes, offsets, _, _ = words(rows[a:b])
                node = identities(hashes, offsets)
                runs, starts = shingles(hashes, offsets, 3)
                sets = [np.unique((runs[x:y] >> U64(32)).astype(np.uint32)).view(np.int32) for x, y in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(_signed(x) for x in node.T), pa.array(sets, pa.list_(pa.int32()))], names=["n0", "n1", "runs"])

    made = texts.select("text").mapInArrow(run, "n0 bigint, n1 bigint, runs array<int>")
    return made.select(F.struct("n0", "n1").alias("node"), "runs").dropDuplicates(["node"])


def audits(pairs: DataFrame) -> DataFrame:
    """(shard, blocks, recall, beam): the recall that each task's sample of queries reached against exact search."""
    return pairs.filter("part = -1").select(F.col("b.n0").alias("shard"), F.col("b.n1").alias("blocks"), (F.col("a.n0") / 1e6).alias("recall"), F.col("a.n1").alias("beam"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, keyed: DataFrame, summaries: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets of runs are similar enough; texts are fetched once for each node."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keys = written(summaries.withColumn("node", F.struct("n0", "n1")).join(ends, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key"), "keys")
    runs = written(_runs(keyed.join(_sized(keys, keys.count()), "key", "left_semi")), "runs")
    both = pairs.join(runs.toDF("a", "x"), "a").join(runs.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    out = written(both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), "verified")
    removed(keys)
    removed(runs)
    return out


def _similar(texts: DataFrame, sample: pa.Table, similarity: float) -> DataFrame:
    """All pairs (a, b) of a node of the sample and another node of ``texts`` that are similar enough.

    sample: n0, n1, runs. A similar text has at least one of a node's rarest runs, as many of
    them as may be left out and one more; the texts that have one are compared exactly.
    """
    name = np.stack([sample["n0"].to_numpy(), sample["n1"].to_numpy()], axis=1)
    column_of = sample["runs"].combine_chunks()
    flat, ends = column_of.flatten().to_numpy().view(np.uint32), np.concatenate(([0], np.cumsum(column_of.value_lengths().to_numpy())))
    sets = [flat[x:y] for x, y in zip(ends, ends[1:], strict=False)]
    _, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    often = often[place]
    rare = [x + np.argsort(often[x:y], kind="stable")[: y - x - int(np.ceil(similarity * (y - x) - 1e-9)) + 1] for x, y in zip(ends, ends[1:], strict=False)]
    who = np.repeat(np.arange(len(sets)), [len(r) for r in rare])
    run_of = flat[np.concatenate(rare)]
    order = np.argsort(run_of, kind="stable")
    who, run_of = who[order], run_of[order]

    def run(batches):
        for batch in batches:
            rows = texts_of(batch, "text")
            for a, b in chunks(np.fromiter((len(t) for t in rows), np.int64, len(rows)), 1 << 20):
                hashes, offsets, _, _ = words(rows[a:b])
                node = identities(hashes, offsets)
                runs, starts = shingles(hashes, offsets, 3)
                runs = (runs >> U64(32)).astype(np.uint32)
                low = np.searchsorted(run_of, runs)
                many = np.searchsorted(run_of, runs, "right") - low
                owner = np.repeat(np.repeat(np.arange(b - a), np.diff(starts)), many)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                hits, now, mine = [], -1, None
                for pair in np.unique(owner * len(sets) + who[at]).tolist():
                    k, q = divmod(pair, len(sets))
                    if k != now:
                        now, mine = k, np.unique(runs[starts[k] : starts[k + 1]])
                    x, y = len(sets[q]), len(mine)
                    if min(x, y) >= similarity * max(x, y) - 1e-9:
                        shared = len(np.intersect1d(sets[q], mine, assume_unique=True))
                        if shared >= similarity * (x + y - shared):
                            hits.append((q, k))
                if hits:
                    q, k = np.array(hits).T
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in name[q].T), *(_signed(x) for x in node[k].T)], names=["a0", "a1", "b0", "b1"])

    made = texts.select("text").mapInArrow(run, "a0 bigint, a1 bigint, b0 bigint, b1 bigint").filter("a0 != b0 OR a1 != b1").distinct()
    return made.select(F.struct(F.col("a0").alias("n0"), F.col("a1").alias("n1")).alias("a"), F.struct(F.col("b0").alias("n0"), F.col("b1").alias("n1")).alias("b"))


def _truth(keyed: DataFrame, summaries: DataFrame, nodes: DataFrame, count: int, similarity: float) -> DataFrame | None:
    """Similar pairs (a, b) of sampled nodes, slice by slice until enough nodes have partners."""
    slices, seen, out = max(1, -(-count // SLICE)), 0, None
    for k in range(min(slices, SLICES)):
        chosen = nodes.filter(F.pmod(F.xxhash64("n1", "n0"), F.lit(slices)) == k).select("n0", "n1")
        keys = summaries.join(F.broadcast(chosen), ["n0", "n1"], "left_semi").groupBy("n0", "n1").agg(F.min("key").alias("key")).select("key")
        sample = _runs(keyed.join(F.broadcast(keys), "key", "left_semi")).select("node.n0", "node.n1", "runs").toArrow()
        if not sample.num_rows:
            continue
        pairs = written(_similar(keyed, sample, similarity), "truth")
        seen += pairs.select("a").distinct().count()
        out = pairs if out is None else out.union(pairs)
        if seen >= PARTNERED:
            break
    return out


def _linked(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs with the roots of their ends."""
    for end in ("a", "b"):
        pairs = pairs.join(groups.toDF(end, f"{end}_root"), end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return pairs


def audited_recall(truth: DataFrame, groups: DataFrame) -> float:
    """The lesser of the means by node and by group of the shares of partners that are in a node's group."""
    rows = _linked(truth, groups).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a_root") == F.col("b_root")).cast("double")).alias("share")).select("n", "share").collect()
    share = np.array([r.share for r in rows])
    return min(share.mean(), np.average(share, weights=[1 / r.n for r in rows])) if rows else 1.0


def _groups(nodes: DataFrame, count: int, keyed: DataFrame, summaries: DataFrame, similarity: float, radius: int, shard_rows: int, beam: int, every: bool) -> DataFrame:
    """(node, root) of the groups that verified candidates make."""
    pairs = written(_candidates(nodes, count, radius, shard_rows, beam, every), "candidates")
    least = audits(pairs).agg(F.min("recall")).first()[0]
    if least is not None and least < RECALL:
        # Only where the beam already takes in the whole shard.
        logging.getLogger(__name__).warning("recall of %.3f against exact search", least)
    first = _verified(pairs.filter("part > 0").select("a", "b").distinct(), keyed, summaries, similarity)
    groups = components(first)
    # Candidates outside the forests whose ends the verified edges don't link.
    # They are many within large groups, so while the groups can be broadcast no such pair is shuffled.
    loose, named = pairs.filter("part = 0").select("a", "b"), groups.count()
    loose = loose if named <= BROADCAST_ROWS else loose.distinct()
    rest = written(_linked(loose, _sized(groups, named)).filter("a_root != b_root").select("a", "b").distinct(), "rest")
    if not rest.isEmpty():
        more = _verified(rest, keyed, summaries, similarity)
        if not more.isEmpty():
            groups = components(first.union(more))
    removed(pairs)
    removed(rest)
    return groups


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ident = column(docs, id_col)
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(ident.cast("string"), F.lit("null")), F.coalesce(column(docs, text_col), F.lit("")))))
    return docs.select(key.alias("key"), ident.alias("id"), column(docs, text_col).alias("text"))


def duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, shard_rows: int = SHARD) -> DataFrame:
    """(key, id, kept_key, kept_id, repeats) of all distinct rows that share a group with another, the kept ones included.

    key: a hash of id and text. repeats: how often that very id and text occur. The row with
    the least (id, key) of a group is kept, null ids after others.
    """
    since = mark()
    keyed = _keyed(docs, id_col, text_col)
    summaries = written(_summaries(keyed), "summaries")
    counted = summaries.groupBy("n0", "n1").agg(*[F.first(s).alias(s) for s in _SIGNATURE + _LEAST])
    nodes = written(counted, "nodes")
    count, beam, every = nodes.count(), BEAM, False
    truth = _truth(keyed, summaries, nodes, count, similarity)
    while True:
        groups = _groups(nodes, count, keyed, summaries, similarity, radius, shard_rows, beam, every)
        if truth is None or audited_recall(truth, groups) >= RECALL or (every and beam >= count and radius >= WIDEST):
            break
        # Widen what most of the lost pairs call for.
        lost = _linked(truth, groups).filter("a_root != b_root").select("a", "b").limit(4096)
        for end in ("a", "b"):
            lost = lost.join(nodes.select(F.struct("n0", "n1").alias(end), *[F.col(s).alias(end + s) for s in _SIGNATURE]), end)
        marks = np.array(lost.select(*["a" + s for s in _SIGNATURE], *["b" + s for s in _SIGNATURE]).collect(), np.int64).reshape(-1, 8).view(U64)
        far = _distance(marks[:, :4], marks[:, 4:])
        if radius < WIDEST and ((far > radius).mean() >= 0.5 or beam >= count):
            radius = min(WIDEST, radius + 8)
        elif not every:
            every = True
        else:
            beam *= 2
    node = F.struct("n0", "n1")
    ids = keyed.select("key", "id")
    rows = summaries.select("key", node.alias("node")).groupBy("key", "node").agg(F.count(F.lit(1)).alias("repeats"))
    placed = rows.join(groups, "node", "left").select("key", "repeats", F.coalesce("root", "node").alias("group"))
    sizes = placed.groupBy("group").agg(F.sum("repeats").alias("n")).filter("n > 1").select("group")
    members = written(placed.join(sizes, "group"), "members")
    named = members.join(ids.distinct(), "key").select("key", "id", "group", "repeats")
    least = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("kept"))
    out = written(named.join(least, "group").select("key", "id", F.col("kept.key").alias("kept_key"), F.col("kept.id").alias("kept_id"), "repeats"), "duplicates")
    cleared(since, out)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, shard_rows: int = SHARD) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the least id.

    Groups are connected by verified similarity. Texts are compared by their words in lower
    case; texts of fewer than three words match only if all words are the same. Null and
    empty texts, and texts without a word, match nothing and stay. Null ids come last within
    a group. Of repeated rows one stays, whichever its other columns are. Texts of any length
    are compared whole. An empty table gives an empty table. Other columns are kept.
    """
    key, twice = spare(docs, "key", "twice")
    rows = duplicate_rows(docs, id_col, text_col, similarity, radius, shard_rows)
    # Rows that go, and kept ones that occur more than once; the texts meet these in one join.
    marked = rows.filter("key != kept_key OR repeats > 1").select(F.col("key").alias(key), (F.col("key") == F.col("kept_key")).alias(twice)).distinct()
    ident, text = column(docs, id_col), column(docs, text_col)
    hashed = docs.withColumn(key, F.unhex(F.md5(F.concat_ws("|", F.coalesce(ident.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))))
    counts = {r[twice]: r["count"] for r in marked.groupBy(twice).count().collect()}
    few = _sized(marked, sum(counts.values()))
    if not counts.get(True):
        return hashed.join(few, key, "left_anti").drop(key)
    placed = hashed.join(few, key, "left")
    once = placed.filter(column(placed, twice)).dropDuplicates([key])
    return placed.filter(column(placed, twice).isNull()).unionByName(once).drop(key, twice)



def op4_simhash(spark, sf_dir):
    """All documents that are near-duplicates of one that is kept, with its id."""
    rows = duplicate_rows(table(spark, sf_dir, "documents"))
    return rows.filter("key != kept_key").select(F.col("id").alias("doc_id"), F.col("kept_id"))


QUERIES = {"op4_simhash": op4_simhash}
ORACLE: dict[str, str] = {}
