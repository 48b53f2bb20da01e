"""Near-duplicates by a chosen-path set similarity join on minwise tokens.

Documents with equal shingle sets are one node first. A node's *tokens* are the smallest hashed shingle in each of ``BINS``
bins of the hash range. In each of ``TREES`` independent trees, every document goes to the children of its tree node whose
token it holds and whose hash (of tree, path and token) is below ``1 / (SPLIT * tokens)``: two similar documents meet in
more than one child on average, others seldom. Only tree nodes that hold documents of two components or more are *open*:

1. First pass: in a few trees each node's smallest document is compared with the node's others (as many pairs as rows), so
   groups of copies, whatever their size, join up.
2. Second pass, all trees: open nodes of up to ``NODE`` documents are small, sketches of all pairs across their components are
   compared. Larger ones branch on by one more token, but for what is near their smallest document, the *hub*: documents
   more similar to it than ``CORE`` leave the node, as everything linked to them is near the hub too (1 - similarity is a
   metric). The hub with all that is more similar to it than ``RIM`` is a *ball*; balls of one hub from all trees are one.
3. In balls with two components or more, full sets of core documents are compared with those of all others, in chunks of
   ``CHUNK_BYTES`` and by counting common shingles as a matrix product. A chunk gives out a spanning forest of its links.

Candidates pass a size test and an estimate from 8-bit sketches (``SLACK`` deviations below the threshold), and are
confirmed on full shingle sets. Pairs are never made within a component, and a group of documents that are near to each
other but not linked makes no pairs either, so rows stay in proportion to documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

#: The similarity (percent) of a link.
PERCENT = 80
BINS = 128
TREES, FIRST_TREES = 16, 4
#: Below the similarity of a link, so that a linked pair's shared paths multiply.
SPLIT = 0.6
#: A tree node with more documents branches on.
NODE = 300
#: Similarities to a hub (estimated): of documents that leave its node, and of those that these can be linked to. Of the
#: similarities' complements 1 - RIM is more than 1 - CORE and 1 - PERCENT / 100 together.
CORE, RIM = 0.66, 0.38
#: Bytes of shingle sets that are compared with as many at once; shingles counted at once.
CHUNK_BYTES, COLUMNS = 4_000_000, 4096
SLACK = 4.5
#: A node that is still large at this depth becomes a ball as a whole.
MAX_DEPTH = 8
#: Ids that are broadcast to pick texts out of a scan; a larger set is joined by shuffle.
BROADCAST_IDS = 2_000_000
GROUP_BYTES = 1_000_000

_K = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than a shingle has one, the whole
    sequence; a null text or one without words has none.
    """
    import xxhash

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    upto, a = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + GROUP_BYTES, "right")))
        split = common.split_words(texts.slice(a, b - a), lower=True)
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        hashes = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in names], np.uint64)
        filled = np.array([bool(x) for x in names], bool)[codes] if names else np.zeros(0, bool)
        bounds = np.concatenate([[0], np.cumsum(filled)])[bounds - bounds[0]]
        one = hashes[codes[filled]] if names else np.zeros(0, np.uint64)
        many = np.zeros(max(len(one) - words + 1, 0), np.uint64)
        for k in range(words):
            many = many * _K + one[k : k + len(many)]
        many = mix(many)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= words:
                yield np.unique(many[lo : hi - words + 1])
            elif hi > lo:
                short = np.array([hi - lo], np.uint64)
                for x in one[lo:hi]:
                    short = short * _K + x
                yield mix(short ^ _K)
            else:
                yield np.zeros(0, np.uint64)
        a = b


def sketch(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """Tokens (32-bit) of the filled bins, and 8 bits of every bin (0: empty)."""
    place = shingles >> np.uint64(57)
    first = np.flatnonzero(np.diff(place, prepend=np.uint64(999)))
    value = shingles[first]
    bits = np.zeros(BINS, np.uint8)
    bits[place[first].astype(np.int64)] = value % np.uint64(255) + np.uint64(1)
    return (mix(value) >> np.uint64(32)).astype("<u4").tobytes(), bits.tobytes()


def _features(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (x for b in batches for x in common.slices(b)):
            n, key, tokens, bits = [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                key.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                t, b = sketch(s)
                tokens.append(t)
                bits.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(tokens, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "key", "tokens", "bits"])

    return common.id_and_text(docs).mapInArrow(common.lean(run), "doc_id long, n long, key long, tokens binary, bits binary")


def _branch(rows: DataFrame, trees: range | None = None) -> DataFrame:
    """Children of ``rows`` (key, n, tokens[, path]): from the roots of ``trees``, or one level below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                token = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").astype(np.uint64)
                row = np.repeat(np.arange(len(size)), size)
                bound = (2.0**64 / np.maximum(SPLIT * size, 1.0 + 1e-9)).astype(np.uint64)[row]
                paths = [mix(np.full(len(size), 7 + t, np.uint64)) for t in trees] if trees is not None else [batch.column(3).to_numpy().view(np.uint64)]
                for path in paths:
                    child = mix(path[row] ^ (token * _K))
                    took = np.flatnonzero(mix(child) < bound)
                    at = pa.array(row[took])
                    yield pa.RecordBatch.from_arrays([pa.array(child[took].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["path", "key", "n"])

    columns = ["key", "n", "tokens"] + ([] if trees is not None else ["path"])
    return rows.select(*columns).mapInArrow(common.lean(run), "path long, key long, n long")


def _alike(pairs: DataFrame, nodes: DataFrame, least: float | None = None) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule a link out, or agree in a share of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
            same = ((x == y) & (x > 0)).sum(1)
            either = ((x > 0) | (y > 0)).sum(1)
            share = PERCENT / 100
            good = same >= (either * share - SLACK * np.sqrt(either * share * (1 - share)) if least is None else either * least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same * 1000 // np.maximum(either, 1), pa.int64())], ["a", "b", "alike"]).filter(pa.array(good))

    bits = nodes.select("key", "bits")
    both = pairs.join(bits.select(F.col("key").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("key").alias("b"), F.col("bits").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(common.lean(run), "a long, b long, alike long")


def _compared(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, alike``: within each tree node, the pairs across components that sketches don't rule out.

    A node's rows, ``NODE`` at most, stand together in one partition. The documents outside the node's largest component
    are compared with all others, a block at a time, and only pairs that pass are given out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(path)) + 1
            if held and held[-1].column(0)[0].as_py() != path[0]:
                yield from _node(held)
                held = []
            for lo, hi in zip([0, *cuts], [*cuts, len(path)], strict=True):
                if lo and held:
                    yield from _node(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _node(held)

    bits = rows.join(nodes.select("key", "bits"), "key").select("path", "key", "n", "part", "bits")
    together = bits.repartition(common.partitions(rows.sparkSession), "path").sortWithinPartitions("path")
    return together.mapInArrow(common.lean(run), "a long, b long, alike long")


def _node(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, n, part = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (1, 2, 3))
    bits = np.frombuffer(b"".join(x for b in batches for x in b.column(4).to_pylist()), np.uint8).reshape(-1, BINS)
    names, size = np.unique(part, return_counts=True)
    few = np.flatnonzero(part != names[size.argmax()])
    share, filled = PERCENT / 100, (bits > 0).astype(np.float32)
    # empty bins agree with nothing, as they are 0 on one side and 256 on the other
    left, right = bits.astype(np.int16), bits.astype(np.int16)
    right[right == 0] = 256
    for k in range(0, len(few), 64):
        i = few[k : k + 64]
        good = (part[i, None] != part) & (np.minimum(n[i, None], n) * 100 >= np.maximum(n[i, None], n) * PERCENT)
        same = np.bitwise_count(np.packbits(left[i, None, :] == right[None, :, :], axis=2).view(np.uint64)).sum(2, dtype=np.int64)
        either = (filled[i].sum(1)[:, None] + filled.sum(1) - filled[i] @ filled.T).astype(np.int64)
        good &= same >= either * share - SLACK * np.sqrt(either * share * (1 - share))
        at, other = np.nonzero(good)
        a, b = key[i][at], key[other]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(same[at, other] * 1000 // np.maximum(either[at, other], 1), pa.int64())], ["a", "b", "alike"])


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full shingle sets, computed from the texts of the documents in question."""
    keys = common.written(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct().join(nodes.select("key", "doc_id"), "key"), "wanted")
    full = _sets(keys, docs, words)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.select("a", "b").join(full.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    out = common.written(joined.select("a", "b", "x", "y").mapInArrow(common.lean(compare), "a long, b long"), "linked")
    common.dropped(full, keys)
    return out


def _labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("part", F.col("key"))
    return rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("root", "key")).drop("root")


def _sized(a: str, b: str):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs of each tree node's smallest document with its others of another component."""
    hub = rows.groupBy("path").agg(F.min(F.struct("key", "n", "part")).alias("hub"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    pairs = rows.join(hub.select("path", "hub"), "path").where((F.col("part") != F.col("hub.part")) & _sized("n", "hub.n"))
    return pairs.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b"))


def _hubs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.min(F.struct("key", "n")).alias("hub"))


def _ball(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hub, key, core`` of the documents near the hubs of these tree nodes, and the rows that stay in the nodes."""
    marked = common.written(rows.select("path", "key", "n").join(_hubs(rows), "path").select("path", "key", "n", "hub"), "hubs")
    stars = marked.where((F.col("key") != F.col("hub.key")) & (F.least("n", "hub.n") >= F.greatest("n", "hub.n") * RIM))
    near = _alike(stars.select(F.col("hub.key").alias("a"), F.col("key").alias("b")).distinct(), nodes, RIM)
    near = common.written(near.select(F.col("a").alias("hub"), F.col("b").alias("key"), (F.col("alike") >= 1000 * CORE).alias("core")), "ball")
    gone = near.where("core").select("hub", "key")
    left = marked.where(F.col("key") != F.col("hub.key")).select("path", "key", "n", F.col("hub.key").alias("hub")).join(gone, ["hub", "key"], "left_anti")
    return near, left.select("path", "key", "n")


def _sets(keys: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``key, shingles`` of the nodes ``keys`` (key, doc_id; written), from their documents' texts."""
    wanted = keys.select("doc_id").distinct()
    wanted = F.broadcast(wanted) if keys.count() <= BROADCAST_IDS else wanted
    texts = common.id_and_text(docs).join(wanted, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (x for b in batches for x in common.slices(b)):
            found = [s.tobytes() for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(s) - (1 << 63) for s in found], pa.int64()), pa.array(found, pa.binary())], ["key", "shingles"])

    full = texts.mapInArrow(common.lean(sets), "key long, shingles binary").join(keys.select("key").distinct(), "key", "left_semi")
    return common.written(full.dropDuplicates(["key"]), "sets")


def _linked_in_balls(balls: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Links (a, b) that join up what is linked within balls (hub, key, core): core documents against all, on full sets."""
    members = balls.unionByName(balls.select("hub", F.col("hub").alias("key"), F.lit(True).alias("core"))).groupBy("hub", "key").agg(F.max("core").alias("core"))
    members = _labelled(members.join(nodes.select("key", "n", "doc_id"), "key"), roots)
    mixed = members.groupBy("hub").agg(F.sum("n").alias("total"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    chunks = F.ceil(F.col("total") * 8 / CHUNK_BYTES).cast("int").alias("chunks")
    members = common.written(members.join(mixed.select("hub", chunks), "hub"), "members")
    full = _sets(members.select("key", "doc_id").distinct(), docs, words)
    own, every = F.pmod(F.hash("key"), F.col("chunks")), F.sequence(F.lit(0), F.col("chunks") - 1)
    left = members.where("core").select("hub", own.alias("x"), F.explode(every).alias("y"), "key", "part", F.lit(True).alias("first"))
    right = members.select("hub", F.explode(every).alias("x"), own.alias("y"), "key", "part", F.lit(False).alias("first"))
    rows = left.unionByName(right).join(full, "key").select("hub", "x", "y", "first", "key", "part", "shingles")
    together = rows.repartition(common.partitions(docs.sparkSession), "hub", "x", "y").sortWithinPartitions("hub", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            names = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if hi > lo:
                    if held and tuple(names[lo]) != name:
                        yield _forest(held)
                        held = []
                    name = tuple(names[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield _forest(held)

    out = common.written(together.mapInArrow(common.lean(run), "a long, b long"), "linked")
    common.dropped(full, members)
    return out


def _forest(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A spanning forest of the links between the first and the other documents of a pair of chunks."""
    first = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in batches]).astype(bool)
    key, part = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (4, 5))
    sets = [np.frombuffer(x, np.uint64) for b in batches for x in b.column(6).to_pylist()]
    sides = [np.flatnonzero(first), np.flatnonzero(~first)]
    a, b = [], []
    if all(len(x) for x in sides):
        size = [np.array([len(sets[i]) for i in side]) for side in sides]
        flat = [np.concatenate([sets[i] for i in side]) for side in sides]
        owner = [np.repeat(np.arange(len(side)), n) for side, n in zip(sides, size, strict=True)]
        shared = np.intersect1d(flat[0], flat[1])
        where = [np.searchsorted(shared, x) for x in flat]
        real = [shared[np.minimum(w, len(shared) - 1)] == x if len(shared) else np.zeros(len(x), bool) for w, x in zip(where, flat, strict=True)]
        both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
        for at in range(0, len(shared), COLUMNS):
            tables = []
            for w, ok, who, side in zip(where, real, owner, sides, strict=True):
                some = np.flatnonzero(ok & (w >= at) & (w < at + COLUMNS))
                table = np.zeros((len(side), min(COLUMNS, len(shared) - at)), np.float32)
                table[who[some], w[some] - at] = 1
                tables.append(table)
            both += tables[0] @ tables[1].T
        good = (100 + PERCENT) * both >= PERCENT * (size[0][:, None] + size[1][None, :])
        good &= part[sides[0]][:, None] != part[sides[1]][None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(good), strict=True):
            s, t = int(sides[0][i]), int(sides[1][j])
            p, q = find(int(part[s])), find(int(part[t]))
            if p != q:
                root[p] = q
                a.append(int(key[s]))
                b.append(int(key[t]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _best(pairs: DataFrame) -> DataFrame:
    """For each larger document the likeliest of its pairs: enough to join a group up, at most one for each document."""
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("alike", "a")).alias("a")).select("a", "b")


def _roots(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return graph.components(out)


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``, over shingles of ``words`` words.

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks the row that bears it. A null or empty
    text has no shingles, links with nothing and is kept; so is a row without doc_id, whose component_id is null. Equal
    texts are one component; of repeated rows with the same doc_id all are marked kept if it is the smallest. An empty
    table gives no rows; only ``doc_id`` and ``text`` are read.
    """
    base = common.written(_features(docs, words), "features")
    named = base.where("n > 0 AND doc_id IS NOT NULL")
    nodes = common.written(named.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits")), "nodes")

    level = common.written(_branch(nodes, range(FIRST_TREES)), "level")
    found = common.written(_alike(_stars(_labelled(level, None)).distinct(), nodes), "pairs")
    links = [_confirmed(_best(found), nodes, docs, words)]
    roots = _roots(links)
    common.dropped(level)
    pending = [found]

    level = common.written(_branch(nodes, range(TREES)), "level")
    balls = []
    for depth in range(1, MAX_DEPTH + 1):
        rows = _labelled(level, roots)
        open_ = rows.groupBy("path").agg(F.count("*").alias("members"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
        rows = common.written(rows.join(open_.select("path", "members"), "path"), "open")
        small, large = rows.where(F.col("members") <= NODE), rows.where(F.col("members") > NODE)
        pending.append(common.written(_compared(small, nodes).distinct(), "pairs"))
        common.dropped(level)
        if not large.limit(1).count():
            break
        if depth == MAX_DEPTH:
            whole = large.join(_hubs(large), "path").select(F.col("hub.key").alias("hub"), "key", F.lit(True).alias("core"))
            balls.append(common.written(whole.distinct(), "ball"))
            break
        near, left = _ball(large, nodes)
        balls.append(near)
        level = common.written(_branch(left.join(nodes.select("key", "tokens"), "key")), "level")
        common.dropped(rows)
    links, roots, _ = _settle(links, roots, pending, nodes, docs, words, every=True)
    if balls:
        links.append(_linked_in_balls(reduce(DataFrame.unionByName, balls), roots, nodes, docs, words))
        roots = _roots(links)

    named = _labelled(nodes.select("key", "doc_id"), roots)
    smallest = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    owner = named.join(smallest, "part").select("key", "component_id")
    out = base.select("doc_id", "n", "key").join(owner, "key", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` without those that aren't their group's kept document; all columns, whatever their names.

    Null and empty texts, and rows without doc_id, stay; repeated rows with a kept doc_id all stay; an empty table gives an
    empty one.
    """
    gone = near_duplicates(docs, words).where(~F.col("kept")).select("doc_id").distinct()
    return common.without_ids(docs, common.written(gone, "dropped"))


def _settle(links: list[DataFrame], roots: DataFrame, pending: list[DataFrame], nodes: DataFrame, docs: DataFrame, words: int, every: bool = False) -> tuple:
    """Confirm candidates across components: the likeliest of each document first, then, if ``every``, all that remain."""
    pairs = pending[0]
    for x in pending[1:]:
        pairs = pairs.unionByName(x)
    for best in (True, False) if every else (True,):
        named = _labelled(_labelled(pairs.withColumnRenamed("a", "key"), roots).withColumnRenamed("key", "a").withColumnRenamed("part", "pa").withColumnRenamed("b", "key"), roots)
        cross = common.written(named.where("pa <> part").select("a", F.col("key").alias("b"), "alike").distinct(), "cross")
        if not cross.limit(1).count():
            break
        links = [*links, _confirmed(_best(cross) if best else cross, nodes, docs, words)]
        roots = _roots(links)
        pairs = cross
    return links, roots, [pairs]


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT rid, doc_id, s FROM (
    SELECT rid, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS s
    FROM docs)
), sizes AS (
  SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), inter AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.rid <> y.rid GROUP BY 1, 2
), links AS (
  SELECT a, b FROM inter JOIN sizes p ON p.rid = a JOIN sizes q ON q.rid = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT rid AS a, rid AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), part AS (
  SELECT r.a AS rid, min(d.doc_id) AS component_id FROM reach r JOIN docs d ON d.rid = r.b GROUP BY 1
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN part USING (rid) LEFT JOIN sizes USING (rid)
"""
