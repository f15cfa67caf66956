"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

Every document with distinct content is SIGNATURE minwise values of its shingle set. In each of TREES independent trees a node picks, by hashes of its
path, about 1 / similarity of the SIGNATURE coordinates; a document goes down to one child for each picked coordinate and
its value there. Nodes of one document end; small nodes are compared exhaustively; larger ones branch again, up to DEPTH levels. Documents that by
their signatures may have a partner in another component of their node are compared on full shingle sets, inside the node. A node gives no more
links than it takes to join its components, and the first trees' components spare most of the other trees' nodes. A node that stays large is mostly one
group of copies: its documents are first compared with a hub, one each, and only those outside the hub's component then meet the others in blocks. So
what is written grows with the documents, not with the pairs of a large group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm import shared
from tessella.llm.shared import drop, likely, small, stored, weighted_join

SHINGLE, SIMILARITY = 5, 0.85
SIGNATURE, TREES, DEPTH = 128, 16, 4
#: Documents of a node that are compared exhaustively; larger nodes branch.
NODE = 64
#: Cells of one membership matrix (16 MB).
CELLS = 1 << 22
#: Trees of the first batch: it joins most copies, so that the other trees' nodes hold few documents of different components.
FIRST_TREES = 2
#: Documents of a block of a node that is still larger than two blocks after the last level, see _blocked(); and the hubs that such a node is compared with at most.
BLOCK, HUBS = 1024, 8
#: Shingles of all hubs of a round that are broadcast at most (8 MB).
HUB_SHINGLES = 1 << 20
_rng = np.random.default_rng(11)
MULTIPLIERS = _rng.integers(1, 1 << 63, SIGNATURE).astype(B.U) * B.U(2) + B.U(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and their bounds. Fewer words than `size`: the whole sequence is one shingle."""
    h, _, _, first = B.word_hashes(B.lowered(buf), off, B.NOT_SPACE)
    g = B.grams(h, size)
    out, count = [], np.zeros(len(off) - 1, np.int64)
    for d, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if z - a >= size:
            x = np.unique(g[a : z - size + 1])
        elif z > a:
            x = B.mix(B.grams(h[a:z], z - a) + B.U(z - a))
        else:
            continue
        out.append(x)
        count[d] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, B.U)), np.concatenate([[0], np.cumsum(count)])


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values modulo 2 ** 64."""
    out = np.zeros(len(x) + 1, B.U)
    np.cumsum(x, out=out[1:])
    return out


def set_digests(sets: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit digests of each set."""
    acc = [_running(B.mix(sets + B.U(s))) for s in (1, 2)]
    return [(a[bounds[1:]] - a[bounds[:-1]]).view(np.int64) for a in acc]


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SIGNATURE minwise values (32 bits) of each document; zero for empty sets."""
    out = np.zeros((len(bounds) - 1, SIGNATURE), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k, m in enumerate(MULTIPLIERS):
            out[full, k] = np.minimum.reduceat(sets * m, bounds[full]) >> B.U(32)
    return out


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, key (a digest of the text), n_shingles, set_a and set_b (a 128-bit digest of the set), signature, for every row."""

    def sketch(batches):
        for batch in batches:
            buf, off = B.column(batch.column(2))
            for i, j, b, o in B.blocks(buf, off, 1 << 19):
                sets, bounds = shingle_sets(b, o, size)
                sig = signatures(sets, bounds)
                dig = set_digests(sets, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(dig[0]), pa.array(dig[1]), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "key", "n_shingles", "set_a", "set_b", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(sketch, "doc_id long, key long, n_shingles long, set_a long, set_b long, signature binary")


def _short(reps: DataFrame) -> DataFrame:
    """rep and the low byte of each value of its signature: enough to compare two (unequal values agree in 1 of 256), a quarter of the size."""

    def cut(batches):
        for batch in batches:
            low = B.column(batch.column(1))[0].reshape(-1, SIGNATURE, 4)[:, :, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in low], pa.binary())], names=["rep", "short"])

    return reps.select("rep", "signature").mapInArrow(cut, "rep long, short binary")


def _chosen(tree: int, similarity: float) -> np.ndarray:
    """Which coordinates the root of a tree picks (about 1 / similarity of them, one at least)."""
    rng = np.random.default_rng((tree + 1) * 1000)
    return rng.choice(SIGNATURE, 1 + (rng.random() < 1 / similarity - 1), replace=False)


def _picked(node: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The coordinate that each node picks by its path, and the second one of those that pick two, else -1."""
    h = B.mix(node + B.U(0x9E3779B97F4A7C15))
    first = (h % B.U(SIGNATURE)).astype(np.int64)
    second = (first + 1 + ((h >> B.U(16)) % B.U(SIGNATURE - 1)).astype(np.int64)) % SIGNATURE
    return first, np.where((h >> B.U(40)).astype(np.float64) / (1 << 24) < 1 / similarity - 1, second, -1)


def _first_nodes(reps: DataFrame, trees: range, similarity: float) -> DataFrame:
    """node, rep, tree of every document's children of the roots."""

    def branch(batches):
        for batch in batches:
            rep = batch.column(0)
            sig = _matrix(batch.column(1))
            for t in trees:
                for c in _chosen(t, similarity):
                    node = B.mix(sig[:, c].astype(B.U) + B.U(c << 33) + B.U((t + 1) << 48))
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), rep, pa.array(np.full(len(node), t), pa.int32())], names=["node", "rep", "tree"])

    return reps.select("rep", "signature").mapInArrow(branch, "node long, rep long, tree int")


def _branch(rows: DataFrame, similarity: float) -> DataFrame:
    """Children of the nodes of rows (node, rep, tree, short). The low byte of a value tells children apart: unequal values share a child once in 256 times, and equal ones always."""

    def branch(batches):
        for batch in batches:
            node, sig = batch.column(0).to_numpy().view(B.U), B.column(batch.column(3))[0].reshape(-1, SIGNATURE)
            for c in _picked(node, similarity):
                at = np.flatnonzero(c >= 0)
                child = B.mix(node[at] * B.U(0xD6E8FEB86659FD93) + sig[at, c[at]].astype(B.U) + (c[at].astype(B.U) << B.U(33)))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at))], names=["node", "rep", "tree"])

    return rows.select("node", "rep", "tree", "short").mapInArrow(branch, "node long, rep long, tree int")


def _matrix(col) -> np.ndarray:
    return B.column(col)[0].view(np.uint32).reshape(-1, SIGNATURE)


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows without most of those whose rep is not in keys, of a stored table; a join decides."""
    h = F.xxhash64("rep").alias("_h")
    return likely(rows.select("*", h), keys.select(h), "_h").drop("_h")


def _mains(rows: DataFrame) -> DataFrame:
    """node, main (the component with most documents of a node), m (these documents), r (the others) of rows (node, label)."""
    counts = rows.groupBy("node", "label").agg(F.count("*").alias("c"))
    return counts.groupBy("node").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("m"), (F.sum("c") - F.max("c")).alias("r"))


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """node, rep, label of nodes of at most about 2 * block documents, from rows (node, rep, n, label) of nodes of several components.

    A larger node becomes one node for each block of its main component and block of its other documents, and one for each two blocks of the others: documents of the
    main component need not meet each other. Rows grow with m + r + m * r / block, and hubs() has left r small.
    """
    fine, large = rows.where(F.col("n") <= 2 * block), rows.where(F.col("n") > 2 * block)
    if large.isEmpty():
        return fine.select("node", "rep", "label")
    of = _mains(large)
    blocks = lambda c: F.greatest(F.lit(1), F.expr(f"cast(ceil({c} / {float(block)}D) as int)"))
    large = large.join(small(of), "node").withColumns({"_km": blocks("m"), "_kr": blocks("r"), "_in": F.col("label") == F.col("main")})
    large = large.withColumn("_b", F.pmod(F.xxhash64("rep", F.lit(5)), F.when(F.col("_in"), F.col("_km")).otherwise(F.col("_kr"))).cast("int"))
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    cross = large.select("node", "rep", "label", "_in", "_b", F.explode(F.when(F.col("_in"), upto("_kr")).otherwise(upto("_km"))).alias("_o"))
    cross = cross.select(F.xxhash64("node", F.when(F.col("_in"), F.col("_b")).otherwise(F.col("_o")), F.when(F.col("_in"), F.col("_o")).otherwise(F.col("_b"))).alias("node"), "rep", "label")
    rest = large.where("not _in and _kr > 1").select("node", "rep", "label", "_b", F.explode(upto("_kr")).alias("_o")).where("_o <> _b")
    rest = rest.select(F.xxhash64("node", F.least("_b", "_o"), F.greatest("_b", "_o"), F.lit("rest")).alias("node"), "rep", "label")
    return fine.select("node", "rep", "label").unionByName(cross).unionByName(rest)


def _near_hubs(rows: DataFrame, share: float) -> DataFrame:
    """a, b: reps of a and of the hub of its node whose signatures agree in at least `share` of the values. rows: rep, short, hub, hub_short."""

    def near(batches):
        for batch in batches:
            one, two = (B.column(batch.column(c))[0].reshape(-1, SIGNATURE) for c in (1, 3))
            ok = pa.array((one == two).sum(1) >= share * SIGNATURE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(2).filter(ok)], names=["a", "b"])

    return rows.select("rep", "short", "hub", "hub_short").mapInArrow(near, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b of the pairs (a, b: a hub; stored) whose full sets (rep, shingles) are similar enough.

    The hubs' sets are broadcast if they are small in all; pairs are then shuffled without a set.
    """
    hubs = sets.join(small(pairs.select(F.col("b").alias("rep")).distinct()), "rep", "left_semi")
    few = (hubs.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= HUB_SHINGLES
    side = lambda d, c: d.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}"))
    if few:
        d = pairs.join(side(_among(sets, pairs.select(F.col("a").alias("rep"))), "a").hint("merge"), "a").join(F.broadcast(side(hubs, "b")), "b")
    else:  # a hub's pairs are many, its set is one row: Spark splits such a join
        d = pairs.join(side(sets, "b").hint("merge"), "b").join(side(sets, "a").hint("merge"), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return d.where(100 * both >= round(similarity * 100) * (F.size("sa") + F.size("sb") - both)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _alike(label: np.ndarray, short: np.ndarray, share: float) -> np.ndarray:
    """Which documents of a node have a partner in another component whose signature agrees in at least `share` of the values."""
    out = np.zeros(len(label), bool)
    for i in range(len(label) - 1):
        hit = np.flatnonzero(((short[i + 1 :] == short[i]).sum(1) >= share * SIGNATURE) & (label[i + 1 :] != label[i]))
        if len(hit):
            out[i] = True
            out[i + 1 + hit] = True
    return out


def shared_counts(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Size of the intersection of every two of the sets values[bounds[i] : bounds[i + 1]], as products of membership matrices of at most CELLS cells."""
    n = len(bounds) - 1
    _, column = np.unique(values, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((n, n), np.int32)
    every = int(column[-1]) + 1 if len(column) else 0
    wide = min(max(every, 1), max(256, CELLS // n))
    for low in range(0, every, wide):
        a, z = np.searchsorted(column, [low, low + wide])
        m = np.zeros((n, wide), np.float32)
        m[row[a:z], column[a:z] - low] = 1
        out += (m @ m.T).astype(np.int32)
    return out


def _links(rep: np.ndarray, label: np.ndarray, values: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the documents of a node, by full sets: enough of them to join all components that the node's links join."""
    size = np.diff(bounds)
    both = shared_counts(values, bounds)
    _, part = np.unique(label, return_inverse=True)
    out = []
    for i in range(len(rep) - 1):  # a row at a time: a node's pairs are never listed
        b = both[i, i + 1 :].astype(np.int64)
        new = (100 * b >= percent * (size[i] + size[i + 1 :] - b)) & (part[i + 1 :] != part[i])
        for j in (i + 1 + np.flatnonzero(new)).tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((min(int(rep[i]), int(rep[j])), max(int(rep[i]), int(rep[j]))))
    return out


def _by_node(batches):
    """Tables of whole nodes from batches sorted by node (first column); the last node of a batch waits for the next batch."""
    rest = None
    for batch in _ended(batches):
        t = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None:
            t = rest if t is None else pa.concat_tables([rest, t])
        if t is None or not t.num_rows:
            continue
        t = t.combine_chunks()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(t.column(0).to_numpy())) + 1, [t.num_rows]])
        if batch is not None:
            rest, edges = t.slice(int(edges[-2])), edges[:-1]
        yield t, edges.tolist()


def _ended(batches):
    yield from batches
    yield None


def alike(nodes: DataFrame, share: float) -> DataFrame:
    """node, rep, label of documents to be compared in full: those with a partner in their node, in another component, of a similar signature."""

    def rows(batches):
        for t, edges in _by_node(batches):
            label, short = t.column("label").to_numpy(), B.column(t.column("short"))[0].reshape(-1, SIGNATURE)
            keep = np.zeros(len(label), bool)
            for i, j in zip(edges[:-1], edges[1:]):
                keep[i:j] = _alike(label[i:j], short[i:j], share)
            if keep.any():
                yield from t.select(["node", "rep", "label"]).filter(pa.array(keep)).to_batches()

    d = nodes.select("node", "rep", "label", "short").repartition("node").sortWithinPartitions("node")
    return d.mapInArrow(rows, "node long, rep long, label long")


def proven(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links of the nodes in found (node, rep, label), proven on full sets (rep, shingles): at most one fewer for each node than it has documents."""
    percent = round(similarity * 100)

    def rows(batches):
        for t, edges in _by_node(batches):
            rep, label = t.column("rep").to_numpy(), t.column("label").to_numpy()
            shingles = t.column("shingles").combine_chunks()
            shingles = shingles.chunk(0) if isinstance(shingles, pa.ChunkedArray) else shingles
            off, values, out = shingles.offsets.to_numpy(), shingles.values.to_numpy(), []
            for i, j in zip(edges[:-1], edges[1:]):
                out += _links(rep[i:j], label[i:j], values[off[i] : off[j]], off[i : j + 1] - off[i], percent)
            if out:
                x = np.array(sorted(set(out)), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    d = found.join(sets, "rep").select("node", "rep", "label", "shingles").repartition("node").sortWithinPartitions("node")
    return d.mapInArrow(rows, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """rep, label (smallest rep of its component) of every rep in links (a, b), by large-star and small-star rounds, each stored."""
    e = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    while True:
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        down = large.distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        nxt = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        nxt = stored(nxt, "stars")
        # stars: every rep has one neighbour below it, and no centre is below another
        ends = nxt.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or (up = 1 and low = 0)").isEmpty():
            break
        drop(e)
        e = nxt
    out = stored(nxt.select(F.col("a").alias("rep"), F.col("b").alias("label")).unionByName(nxt.select(F.col("b").alias("rep"), F.col("b").alias("label")).distinct()), "components")
    drop(e, nxt)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """rep, shingles of the contents in wanted (rep, set_a, set_b, first: a document that holds it)."""

    def sets(batches):
        for batch in batches:
            buf, off = B.column(batch.column(0))
            for _, _, b, o in B.blocks(buf, off, 1 << 19):
                got, bounds = shingle_sets(b, o, size)
                digests = [pa.array(d) for d in set_digests(got, bounds)]
                arrays = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*digests, arrays], names=["set_a", "set_b", "shingles"])

    ids = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    if wanted.count() > shared.BROADCAST_ROWS:  # texts are shuffled
        h = lambda c: F.xxhash64(c).alias("_h")
        ids = likely(ids.select("*", h("_id")), wanted.select(h("first")), "_h")
    first = small(wanted.select(F.col("first").alias("_first")).distinct())
    found = ids.join(first, F.col("_id").eqNullSafe(F.col("_first")), "left_semi").select("text").mapInArrow(sets, "set_a long, set_b long, shingles array<long>")
    return found.join(small(wanted.select("rep", "set_a", "set_b")), ["set_a", "set_b"]).select("rep", "shingles").dropDuplicates(["rep"])


def _unsettled(nodes: DataFrame, label: DataFrame | None) -> DataFrame:
    """nodes that hold more than one component, with label: the component of rep, itself if it has no link."""
    if label is None:
        return nodes.withColumn("label", F.col("rep"))
    now = nodes.join(small(label), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = now.groupBy("node").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("n")).where("l <> h").select("node", "n")
    return weighted_join(now, stored(mixed, "mixed"), ["node"])


def _relabelled(label: DataFrame | None, new: DataFrame) -> DataFrame:
    """Labels after new links: components of the links between the components so far, then of their members."""
    if label is None:
        return components(new)
    new = new.select("a", "b")
    small_label = small(label)
    for c in "ab":
        new = new.join(small_label.select(F.col("rep").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(c, F.coalesce(f"l{c}", c)).drop(f"l{c}")
    moved = components(new.where("a <> b"))
    known = label.join(small(moved.select(F.col("rep").alias("label"), F.col("label").alias("_to"))), "label", "left").select("rep", F.coalesce("_to", "label").alias("label"))
    fresh = moved.join(small_label.select("rep"), "rep", "left_anti")
    return stored(known.unionByName(fresh.select("rep", "label")), "labels")


def look(similarity: float) -> float:
    """Share of coordinates in which the signatures of a pair must agree for it to be proven on sets: 4.5 standard errors under the similarity."""
    return similarity - 4.5 * (similarity * (1 - similarity) / SIGNATURE) ** 0.5


class _Join:
    """The state of one similarity join: labels, and the sets that have been read so far."""

    def __init__(self, docs: DataFrame, reps: DataFrame, similarity: float, size: int, block: int):
        self.docs, self.reps, self.similarity, self.size, self.block = docs, reps, similarity, size, block
        self.short = stored(_short(reps), "short-signatures")
        self.label: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.links: list[DataFrame] = []
        self.used: list[DataFrame] = [self.short]

    def read(self, ends: DataFrame) -> bool:
        """Reads the sets of reps in ends that aren't there yet; whether there are any sets at all."""
        if self.sets is not None:
            ends = ends.join(self.sets.select("rep"), "rep", "left_anti")
        wanted = stored(self.reps.join(ends, "rep", "left_semi").select("rep", "set_a", "set_b", "first"), "wanted")
        if not wanted.isEmpty():
            more = stored(_sets(self.docs, wanted, self.size), "sets")
            self.used.append(more)
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        drop(wanted)
        return self.sets is not None

    def add(self, new: DataFrame) -> None:
        new = stored(new.distinct(), "proven")
        if not new.isEmpty():
            self.links.append(new)
            before, self.label = self.label, _relabelled(self.label, new)
            drop(before)

    def hubs(self, nodes: DataFrame) -> None:
        """Compares the documents of large nodes with one hub of their node, as long as this takes a tenth of those outside the main components away."""
        last = None
        for k in range(HUBS):
            rows = stored(_unsettled(nodes, self.label).select("node", "rep", "label"), "large-nodes")
            of = stored(_mains(rows), "main-components")
            rest = of.agg(F.sum(F.when(F.col("r") > self.block, F.col("r")))).first()[0] or 0
            if not rest or last and rest > 0.9 * last:
                drop(rows, of)
                return
            last = rest
            large = rows
            rows = rows.join(small(of.where(F.col("r") > self.block).select("node", "main", "m")), "node")
            outside = rows.where("label <> main or m = 1")
            hub = outside.groupBy("node").agg(F.min_by(F.struct(F.col("rep").alias("hub"), F.col("label").alias("hub_label")), F.xxhash64("rep", F.lit(k))).alias("h")).select("node", "h.*")
            heads = stored(hub, "hub-numbers")
            hub = stored(self.short.select(F.col("rep").alias("hub"), F.col("short").alias("hub_short")).join(small(heads), "hub"), "hubs")
            drop(heads)
            pairs = rows.join(small(hub), "node").where("label <> hub_label").join(_among(self.short, large), "rep")
            pairs = stored(_near_hubs(pairs, look(self.similarity)).distinct(), "hub-pairs")
            if self.read(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()):
                self.add(verified(pairs, self.sets, self.similarity))
            drop(large, of, hub, pairs)

    def nodes(self, trees: range, depth: int, limit: int) -> DataFrame:
        """A stored table: node, rep, n (documents) of all nodes to be compared (two documents or more); nodes with the same documents are kept once.

        A node over two blocks meets hubs as soon as it is found. It branches only if it still holds several components, and over a block of documents outside its main one.
        """
        rows, out, used = _first_nodes(self.reps, trees, self.similarity), None, []
        for level in range(1, depth + 1):
            if level > 1:
                rows = stored(rows, f"nodes-{level}")
                used.append(rows)
            # a node's size and a digest of its documents, summed before the shuffle: two sums of 40 bits
            what = [F.sum(F.shiftrightunsigned(F.xxhash64("rep", F.lit(k)), 24)).alias(f"what{k}") for k in (1, 2)]
            sizes = stored(rows.groupBy("node").agg(F.count("*").alias("n"), *what).where("n > 1"), f"sizes-{level}")
            used.append(sizes)
            leaf = sizes if level == depth else sizes.where(F.col("n") <= limit)
            once = stored(leaf.groupBy("n", "what1", "what2").agg(F.min("node").alias("node")).select("node", "n", F.col("n").alias("size")), "leaf-nodes")
            used.append(once)
            found = weighted_join(rows, once, ["node"]).select("node", "rep", F.col("size").alias("n"))
            out = found if out is None else out.unionByName(found)
            large = sizes.where(F.col("n") > limit).select("node", "n", F.col("n").alias("size"))
            if level == depth or large.isEmpty():
                break
            rows = stored(weighted_join(rows, large, ["node"]).withColumnRenamed("size", "n"), "large-nodes")
            used.append(rows)
            if not rows.where(F.col("n") > 2 * self.block).isEmpty():
                self.hubs(rows.where(F.col("n") > 2 * self.block).select("node", "rep", "n"))
            if self.label is not None:
                mixed = stored(_unsettled(rows, self.label), "mixed-nodes")
                done = stored(_mains(mixed.where(F.col("n") > 2 * self.block)).where(F.col("r") <= self.block).select("node", (F.col("m") + F.col("r")).alias("n")), "hub-nodes")
                used += [mixed, done]
                out = out.unionByName(weighted_join(mixed.select("node", "rep", F.col("n").alias("size")), done, ["node"]).withColumnRenamed("size", "n"))
                rows = mixed.join(small(done.select("node")), "node", "left_anti")
            rows = _branch(rows.select("node", "rep", "tree").join(self.short, "rep"), self.similarity)
        out = stored(out, "leaves")
        drop(*used)
        return out

    def compare(self, trees: range, depth: int, limit: int) -> None:
        """Finds the links of the nodes of these trees between different components."""
        nodes = self.nodes(trees, depth, limit)
        large = nodes.where(F.col("n") > 2 * self.block)
        if not large.isEmpty():
            self.hubs(large)
        rows = _blocked(_unsettled(nodes, self.label), self.block)
        found = stored(alike(rows.join(self.short, "rep"), look(self.similarity)), "alike")
        if self.read(found.select("rep").distinct()):
            self.add(proven(found, _among(self.sets, found), self.similarity))
        drop(nodes, found)


def similarity_join(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, trees: int = TREES, node: int = NODE, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, contents, links, labels), the first two stored. rows: doc_id, key, n_shingles, set_a, set_b for every document; contents: set_a, set_b, rep, first (its smallest doc_id), n (its documents) for every set but the empty one;
    links: a, b, contents joined into the same components by proven links; labels: rep, label for every content with a link.

    A content is known by both halves of its set's 128-bit digest; rep is a number of its own.
    """
    spark = docs.sparkSession
    rows = stored(sketches(docs, size), "sketches")
    # copies are one content from here on; summed before the shuffle
    reps = rows.where("n_shingles > 0").groupBy("set_a", "set_b", "signature").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "contents")
    slim = stored(rows.drop("signature"), "documents-by-content")
    drop(rows)
    join = _Join(docs, reps, similarity, size, block)
    for part in (range(min(FIRST_TREES, trees)), range(FIRST_TREES, trees)):
        if part:
            join.compare(part, DEPTH, node)
    drop(*join.used)
    links = reduce(DataFrame.unionByName, join.links) if join.links else spark.createDataFrame([], "a long, b long")
    label = join.label if join.label is not None else spark.createDataFrame([], "rep long, label long")
    return slim, reps, links, label


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, trees: int = TREES, node: int = NODE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links; documents without words are linked with nothing, and stay. A null doc_id takes
    the smallest id of its component and isn't kept; rows that repeat the smallest doc_id are all kept. Recall is that of `trees` trees (about
    1 - 3e-6 for a pair just at the similarity in nodes that branch DEPTH times, more elsewhere).
    """
    return _near(docs, similarity, size, trees, node, block)[0].drop("key")


def _near(docs: DataFrame, similarity: float, size: int, trees: int, node: int = NODE, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """near_duplicates() with key, a digest of the text; and the stored tables that it reads."""
    rows, contents, _, label = similarity_join(docs, similarity, size, trees, node, block)
    label = contents.select("rep", "first").join(small(label), "rep")
    low = label.groupBy("label").agg(F.min("first").alias("_low"))
    low = stored(label.join(small(low), "label").select("rep", "_low"), "lowest")
    known = contents.join(small(low), "rep", "left").select("set_a", "set_b", F.coalesce("_low", "first").alias("component_id"), "n")
    known = stored(known, "components-of-contents")
    drop(contents, low)
    cols = ["doc_id", "key", "n_shingles", "component_id"]
    d = weighted_join(rows.where("n_shingles > 0"), known, ["set_a", "set_b"]).select(*cols).unionByName(rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(*cols))
    return d.withColumn("kept", (F.col("n_shingles") == 0) | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), [rows, known]


def drop_near_duplicates(docs: DataFrame, similarity: float, size: int = SHINGLE, trees: int = TREES) -> DataFrame:
    """docs (any columns, with doc_id and text) with one row of each group of near duplicates: the one with the smallest doc_id.

    Rows that repeat a doc_id and its text leave one. Rows without doc_id can't be told apart and stay, as do texts without words.
    """
    key = F.xxhash64("text")
    marks, used = _near(docs.where("doc_id is not null"), similarity, size, trees)
    marks = stored(marks.where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("_n")), "survivors")
    drop(*used)
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (key == F.col("_key"))
    out = docs.where("doc_id is null").unionByName(docs.join(small(marks.where("_n = 1")), same, "left_semi"))
    repeated = marks.where("_n > 1")
    if repeated.isEmpty():
        return out
    more = docs.join(small(repeated), same, "left_semi").groupBy("doc_id", "text").agg(*(F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in ("doc_id", "text")))
    return out.unionByName(more.select(*docs.columns))
