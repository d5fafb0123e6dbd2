"""Near-duplicate groups from DartMinHash signatures over word shingles.

Every element (a shingle, or a part of its weight) throws darts: arrivals of a random process that depends on the element
alone, at the rate of its weight. A text looks at the darts up to a time at which about k (ln k + 2) have been thrown,
whatever its size, and goes on until every coordinate is hit; the earliest dart of a coordinate is its signature there. Two
texts agree in a coordinate with the probability of their (weighted) Jaccard similarity.

Texts with the same shingles are one node. Nodes that share a band are candidates; exact similarity decides. A bucket's nodes
are first compared with one of them only, a few times over, and then across components that are still apart: all of them in
small buckets; in large ones those that share a rare shingle, which loses no pair except where nearly all of both texts'
shingles are common. Such texts get a longer signature with longer bands, whose buckets are treated alike: one node first, then
all that are still apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stagelight.operators.graph import connected_components
from stagelight.sources.scratch import scratch_dir

from .lines import bit_table, in_table, longs
from .text import ALNUM, Words, distinct, mix, picked, prefix, slices, span_hash

SHINGLE, SIMILAR = 5, 0.8
#: (bands, coordinates in a band): a pair at 0.8 shares a band of the first with 0.9999, of the second with 0.999.
BANDS, FINE = (24, 5), (96, 12)
#: Nodes of a bucket that are compared across components one by one; the nodes of larger ones meet by shingles that at most so many of them have.
BUCKET = 40
#: Turns in which nodes are compared with one node of each of their buckets, and as many for the long bands.
TURNS = 3
SLICE = 1 << 18
#: Darts that are thrown at once, which bounds a task's memory.
DARTS = 300_000


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles, ordered by text and hash; a text of 1 to width - 1 words is one shingle."""
    w = Words(texts, ALNUM)
    p = prefix(w.hash)
    n = np.where(w.count >= width, w.count - width + 1, np.minimum(w.count, 1))
    row = np.repeat(np.arange(len(texts)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + w.bounds[:-1][row]
    length = np.minimum(width, w.count[row])
    h = mix(span_hash(p, start, start + length) + length.astype(np.uint64))
    order = np.argsort(h)
    order = order[np.argsort(row[order], kind="stable")]
    row, h = row[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[new], h[new], np.diff(np.append(new, len(row)))


def regions(row: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, element, low end, width, weight) of the parts [0, 1), [1, 2), [2, 4), .. of the weights that a shingle reaches into."""
    rows, parts, lows, widths, weights = [row], [mix(h)], [np.zeros(len(h))], [np.ones(len(h))], [weight]
    low, k = 1.0, 1
    while (m := weight > low).any():
        rows.append(row[m])
        parts.append(mix(h[m] + np.uint64(k * 0xA24BAED4963EE407 % 2**64)))
        lows.append(np.full(m.sum(), low))
        widths.append(np.full(m.sum(), low))
        weights.append(weight[m])
        low, k = 2 * low, k + 1
    return tuple(map(np.concatenate, (rows, parts, lows, widths, weights)))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signed(n: int, row: np.ndarray, h: np.ndarray, weight: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """`signatures` for a few texts at a time; rows are ordered."""
    out, step = np.zeros((n, k), np.uint64), max(1, int(DARTS / (k * (np.log(k) + 2))))
    edge = np.searchsorted(row, np.arange(0, n + step, step))
    for i, (a, z) in enumerate(zip(edge, edge[1:])):
        first = i * step
        out[first : first + step] = signatures(min(step, n - first), row[a:z] - first, h[a:z], weight[a:z], k, seed)
    return out


def signatures(n: int, row: np.ndarray, h: np.ndarray, weight: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """n x k dart ids; 0 everywhere for a text without elements. weight: of each element, positive."""
    row, part, low, width, weight = regions(row, h, np.asarray(weight, float))
    part = part + np.uint64(seed) * np.uint64(0x9FB21C651E98DF25)
    total = np.bincount(row, np.minimum(weight - low, width), n)
    until = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0)
    drawn = mix(part + np.uint64(0xE7037ED1A0B428DB))
    arrival = -np.log(uniform(drawn)) / width
    time, ids = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    waiting = np.arange(len(row))
    while len(waiting):
        live, cells, when, names = waiting, [], [], []
        while len(live := live[arrival[live] <= until[row[live]]]):
            dart = mix(drawn[live] ^ np.uint64(0x589965CC75374CC3))
            inside = low[live] + width[live] * uniform(mix(dart + np.uint64(7))) < weight[live]
            hit = live[inside]
            dart = dart[inside]
            cells.append(row[hit] * k + (dart % np.uint64(k)).astype(np.int64))
            when.append(arrival[hit])
            names.append(dart)
            drawn[live] = mix(drawn[live] + np.uint64(0xE7037ED1A0B428DB))
            arrival[live] -= np.log(uniform(drawn[live])) / width[live]
        if cells:
            cells, when, names = np.concatenate(cells), np.concatenate(when), np.concatenate(names)
            open_ = time[cells] == np.inf  # a coordinate hit before was hit earlier
            cells, when, names = cells[open_], when[open_], names[open_]
            late = np.argsort(-when, kind="stable")
            time[cells[late]], ids[cells[late]] = when[late], names[late]
        missing = (time.reshape(n, k) == np.inf).any(axis=1)
        waiting = np.flatnonzero(missing[row])
        until[missing] *= 2
    return ids.reshape(n, k)


def band_keys(ids: np.ndarray, bands: int, width: int) -> np.ndarray:
    """n x bands keys, different for different bands."""
    out = np.zeros((len(ids), bands), np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x2127599BF4325C37) + ids[:, j : bands * width : width])
    return mix(out + np.arange(bands, dtype=np.uint64))


def set_key(n: int, row: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Key of a text's shingles, whatever their order; 0 for a text without words."""
    out = np.zeros(n, np.uint64)
    if len(row):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[first]] = mix(np.add.reduceat(mix(h + weight.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)), first) | np.uint64(1))
    return out


def elements(texts: list[bytes], weighted: bool):
    row, h, count = shingles(texts)
    return row, h, count if weighted else np.ones(len(count), np.int64)


def node_rows(docs: DataFrame, weighted: bool) -> DataFrame:
    """doc_id, node, bands, sketch (a byte of each coordinate) of every row, and its text_key if docs have one; node 0 and no bands without words."""
    extra = docs.columns[2:]
    bands, width = BANDS

    def run(batches):
        for b in batches:
            for first, texts in slices(b.column(1), SLICE):
                row, h, weight = elements(texts, weighted)
                ids = signed(len(texts), row, h, weight, bands * width)
                has = np.bincount(row, minlength=len(texts)) > 0
                keys = band_keys(ids, bands, width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * bands))), pa.int32()), longs(keys[has].ravel()))
                sketch = (ids & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(first, len(texts)), longs(set_key(len(texts), row, h, weight)), lists,
                    pa.array([s.tobytes() if k else None for s, k in zip(sketch, has)], pa.binary()),
                    *[b.column(2).slice(first, len(texts)) for _ in extra]], names=["doc_id", "node", "bands", "sketch", *extra])

    return docs.mapInArrow(run, "doc_id long, node long, bands array<long>, sketch binary" + "".join(f", {c} long" for c in extra))


def listed(docs: DataFrame, table, weighted: bool, fine: bool) -> DataFrame:
    """For texts whose node is in the bit table: node with bands and a bit of each coordinate of the long signature, or with its shingles and weights."""
    bands, width = FINE

    def run(batches):
        for b in batches:
            for _, texts in slices(b.column(1), SLICE):
                row, h, weight = elements(texts, weighted)
                node = set_key(len(texts), row, h, weight)
                pick = np.flatnonzero(in_table(table.value, node) & (node != 0))
                _, at = np.unique(node[pick], return_index=True)
                pick = pick[at]
                if not len(pick):
                    continue
                place = np.full(len(texts), -1)
                place[pick] = np.arange(len(pick))
                m = place[row] >= 0
                row, h, weight = place[row[m]], h[m], weight[m]
                order = np.argsort(row, kind="stable")
                row, h, weight = row[order], h[order], weight[order]
                n = len(pick)
                if fine:
                    ids = signed(n, row, h, weight, bands * width, 1)
                    keys = band_keys(ids, bands, width)
                    bits = np.packbits((ids >> np.uint64(9) & np.uint64(1)).astype(bool), axis=1).view(np.uint64)
                    many = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), longs(x.ravel()))
                    yield pa.RecordBatch.from_arrays([longs(node[pick]), many(keys), many(bits)], names=["node", "bands", "bits"])
                    continue
                edge = np.searchsorted(row, np.arange(n + 1))
                pack = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(edge, edge[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([longs(node[pick]), pack((h >> np.uint64(32)).astype(np.uint32)), pack(weight.astype(np.uint32)) if weighted else pa.nulls(n, pa.binary())], names=["node", "shingles", "weights"])

    return docs.mapInArrow(run, "node long, bands array<long>, bits array<long>" if fine else "node long, shingles binary, weights binary")


@F.pandas_udf(DoubleType())
def agreement(a, b):
    """Share of equal bytes of two sketches."""
    return a.__class__([np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) for x, y in zip(a, b)], index=a.index, dtype=float)


@F.pandas_udf(DoubleType())
def jaccard(a, wa, b, wb):
    """Jaccard similarity of two sets of packed shingles, weighted if they have packed weights."""

    def one(x, wx, y, wy):
        x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        if wx is None:
            both = len(x) + len(y) - len(distinct(np.concatenate((x, y))))
            return both / (len(x) + len(y) - both)
        wx, wy = np.frombuffer(wx, np.uint32), np.frombuffer(wy, np.uint32)
        _, i, j = np.intersect1d(x, y, return_indices=True)
        both = int(np.minimum(wx[i], wy[j]).sum())
        return both / (int(wx.sum()) + int(wy.sum()) - both)

    return a.__class__([one(*t) for t in zip(a, wa, b, wb)], index=a.index, dtype=float)


def heads(placed: DataFrame, turn: int) -> DataFrame:
    """(a, b): of each node the two nodes of other components that it meets in most buckets, looking at one node of each bucket.

    placed: bucket, node, component. A bucket shows its node with the smallest hash, another one at each turn.
    """
    head = placed.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("r"), "node", "component")).alias("h"))
    met = placed.join(head, "bucket").where("component <> h.component").groupBy("node", F.col("h.node").alias("hub")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "hub"))
    return met.withColumn("r", rank).where("r <= 2").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def across(members: DataFrame, alike=None) -> DataFrame:
    """(a, b): pairs of nodes of a bucket that are in different components; members: bucket, node, component."""
    x, y = members.alias("x"), members.alias("y")
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component"))
    return x.join(y, on if alike is None else on & alike).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def bits_agree():
    """Whether the bits of two long signatures differ in few enough places for SIMILAR: bits agree with (1 + similarity) / 2, 4 deviations allowed."""
    n, p = FINE[0] * FINE[1], (1 + SIMILAR) / 2
    most = int(n * (1 - p) + 4 * (n * p * (1 - p)) ** 0.5)
    return F.aggregate(F.zip_with("x.bits", "y.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v) <= most


def unpacked(hot: DataFrame) -> DataFrame:
    """node, component, total, token, weight: a row for each shingle of nodes (node, component, shingles, weights)."""

    def run(batches):
        for b in batches:
            node, component = b.column(0), b.column(1)
            weights = b.column(3).to_pylist()
            for first, packed in slices(b.column(2), SLICE):
                sizes = np.array([len(x) // 4 for x in packed])
                token = np.frombuffer(b"".join(packed), np.uint32).astype(np.int64)
                held = weights[first : first + len(packed)]
                weight = np.ones(len(token), np.int64) if held[0] is None else np.frombuffer(b"".join(held), np.uint32).astype(np.int64)
                row = np.repeat(np.arange(len(packed)), sizes)
                total = np.bincount(row, weight, len(packed)).astype(np.int64)
                at = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([node.take(at), component.take(at), pa.array(total[row]), pa.array(token), pa.array(weight)],
                                                 names=["node", "component", "total", "token", "weight"])

    return hot.select("node", "component", "shingles", "weights").mapInArrow(run, "node long, component long, total long, token long, weight long")


def by_rare_shingles(hot: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b) of different components that can be SIMILAR and share a rare shingle, and the nodes (node, component) that may have partners without one.

    A shingle of more than BUCKET nodes is common. What two nodes share is at most what they share of rare shingles and the lesser of
    their common weights, so a node whose common weight is below SIMILAR of its whole has no partner without a rare shingle. Rare
    shingles are joined; a family of texts around one template, however large, meets only in what its texts add.
    """
    unpacked(hot).write.parquet(f"{folder}/tokens")
    rows = hot.sparkSession.read.parquet(f"{folder}/tokens")
    spread = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("p"), F.max("component").alias("q")).where("n > 1 and p <> q").select("token", "n")
    rows.join(spread, "token").write.parquet(f"{folder}/spread")
    held = hot.sparkSession.read.parquet(f"{folder}/spread")
    load = held.where(F.col("n") > BUCKET).groupBy("node").agg(F.sum("weight").alias("common"))
    whole = rows.groupBy("node", "component").agg(F.first("total").alias("total")).join(load, "node", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    whole.write.parquet(f"{folder}/loads")
    whole = hot.sparkSession.read.parquet(f"{folder}/loads")
    rare = held.where(F.col("n") <= BUCKET).select("token", "node", "component", "weight").join(whole.select("node", "total", "common"), "node")
    x, y = rare.alias("x"), rare.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")))
    met = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(
        F.sum(F.least("x.weight", "y.weight")).alias("shared"), F.first(F.least("x.common", "y.common")).alias("common"), F.first(F.col("x.total") + F.col("y.total")).alias("both"))
    enough = (F.col("shared") + F.col("common")) * (1 + SIMILAR) >= SIMILAR * F.col("both") - 1e-6
    pairs = met.where(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs, whole.where(F.col("common") >= SIMILAR * F.col("total") - 1e-6).select("node", "component")


def verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Pairs (distinct) whose exact similarity is SIMILAR or more. Pairs that agree far too seldom for it (4 deviations) are not fetched."""
    k = BANDS[0] * BANDS[1]
    least = SIMILAR - 4 * (SIMILAR * (1 - SIMILAR) / k) ** 0.5
    s = sketches.select("node", "sketch")
    near = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", agreement("sa", "sb").alias("g")).where(F.col("g") >= least).select("a", "b")
    full = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa"), F.col("weights").alias("wa")), "a")
    full = full.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb"), F.col("weights").alias("wb")), "b")
    full.where(jaccard("xa", "wa", "xb", "wb") >= SIMILAR).select("a", "b").write.parquet(folder)
    return pairs.sparkSession.read.parquet(folder)


def merged(groups: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """groups (node, component) with the components that edges link put together."""
    ends = edges.join(groups.toDF("a", "ca"), "a").join(groups.toDF("b", "cb"), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).where("a <> b")
    ends.write.parquet(f"{folder}-ends")  # read more than once
    ends = edges.sparkSession.read.parquet(f"{folder}-ends")
    found = connected_components(ends).toDF("component", "whole")
    groups.join(found, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).write.parquet(folder)
    return groups.sparkSession.read.parquet(folder)


def placed(members: DataFrame, groups: DataFrame, folder: str) -> tuple[DataFrame, float]:
    """members with their component, and the number of pairs of nodes of a bucket that are in different ones."""
    members.join(groups, "node").write.parquet(folder)
    out = members.sparkSession.read.parquet(folder)
    k = F.col("k").cast("double")
    each = out.groupBy("bucket", "component").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum(k).alias("n"), F.sum(k * k).alias("own"))
    return out, each.agg(F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("own")), F.lit(0.0))).first()[0] / 2


def still_apart(placed: DataFrame, folder: str) -> DataFrame:
    """The rows (with bucket and component) of the buckets that have several components."""
    apart = placed.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("bucket")
    placed.join(apart, "bucket", "left_semi").write.parquet(folder)
    return placed.sparkSession.read.parquet(folder)


def put_together(members: DataFrame, groups: DataFrame, sketches: DataFrame, sets: DataFrame, folder: str, first: int) -> tuple[DataFrame, DataFrame]:
    """groups and members' rows with their component after up to TURNS turns; they end when a turn takes away less than a quarter of the pairs left.

    Turns only spare the comparison of pairs that are in one component by then, so ending them early loses nothing.
    """
    rest, left = placed(members, groups, f"{folder}/placed{first}")
    for turn in range(first, first + TURNS):
        if not left:
            break
        linked = verified(heads(rest, turn), sketches, sets, f"{folder}/edges{turn}")
        groups = merged(groups, linked, f"{folder}/groups{turn}")
        rest, now = placed(members, groups, f"{folder}/placed{turn + 1}-{first}")
        if now > 0.75 * left:
            break
        left = now
    return groups, rest


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False, folder: str | None = None, by_text: bool = False) -> DataFrame:
    """doc_id, class_id and kept of every row: classes are components of pairs of texts with similarity SIMILAR or more.

    Similarity is that of the sets of shingles (weighted: of their counts) of SHINGLE words. class_id is the smallest id of the
    class, kept is true for the row with that id (repeated rows of it are all kept); a NULL id is larger than others. Texts
    of 1 to 4 words are alike only if they have the same words; texts without words are a class each (class_id is the own id).
    Other columns are not read. With by_text, text_key (xxhash64 of the text) follows.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark)
    own = picked(docs, doc_id=docs[id_col].cast("long"), text=text_col)
    texts = own.select("doc_id", "text")
    key = ["text_key"] if by_text else []
    node_rows(texts.withColumn("text_key", F.xxhash64("text")) if by_text else texts, weighted).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    member = rows.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands")).select("node", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    member.join(shared, "bucket").select("bucket", "node", "n").write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    nodes = members.select("node").distinct()
    table = spark.sparkContext.broadcast(bit_table(nodes, "node"))
    listed(texts, table, weighted, False).groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("weights").alias("weights")).write.parquet(f"{folder}/sets")
    table.destroy()
    sets = spark.read.parquet(f"{folder}/sets")
    rows.where("node <> 0").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch")).write.parquet(f"{folder}/sketches")
    sketches = spark.read.parquet(f"{folder}/sketches")

    members.select("node").distinct().select("node", F.col("node").alias("component")).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    groups, rest = put_together(members, groups, sketches, sets, folder, 0)
    rest = still_apart(rest, f"{folder}/apart")
    large = rest.where(F.col("n") > BUCKET).select("node", "component").distinct().join(sets, "node")
    rare, common = by_rare_shingles(large, folder)
    # nodes of common shingles alone: long bands take their buckets apart
    table = spark.sparkContext.broadcast(bit_table(common, "node"))
    listed(texts, table, weighted, True).join(common, "node").dropDuplicates(["node"]).select("node", "component", "bits", "bands").write.parquet(f"{folder}/fine")
    table.destroy()
    fine = spark.read.parquet(f"{folder}/fine")
    # a family of such texts is put together by its long bands first; only what is then apart is compared in all pairs
    left = still_apart(fine.select("node", "component", F.explode("bands").alias("bucket")), f"{folder}/long").select("bucket", "node")
    groups, left = put_together(left, groups, sketches, sets, folder, TURNS)
    small = rest.where(F.col("n") <= BUCKET).select("bucket", "node").join(groups, "node")
    pairs = across(small).union(rare).union(across(left.join(fine.select("node", "bits"), "node"), bits_agree())).distinct()
    last = merged(groups, verified(pairs, sketches, sets, f"{folder}/edges"), f"{folder}/last")

    by_node = rows.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    by_node = by_node.join(last, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least")
    classes = by_node.groupBy("component").agg(F.min("least").alias("class_id"))
    named = by_node.join(classes, "component").select("node", "class_id")
    out = rows.where("node <> 0").select("doc_id", "node", *key).join(named, "node").select("doc_id", "class_id", *key)
    out = out.unionByName(rows.where("node = 0").select("doc_id", F.col("doc_id").alias("class_id"), *key))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns with one id of each class of `near_groups`; rows that share the kept id and are of that class all stay.

    Decided for each id and text: a row that goes takes no other text with its id (or with none) along.
    """
    gone = near_groups(docs, id_col=id_col, text_col=text_col, by_text=True, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_key")).distinct()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[docs[c].alias(k) for c, k in names.items()])
    left = plain.join(gone, F.col(names[id_col]).cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(names[text_col]) == F.col("_key")), "left_anti")
    return left.select(*[F.col(k).alias(c) for c, k in names.items()])
