"""Near duplicates by weighted Jaccard similarity of word-shingle multisets.

Signatures are BagMinHash: every shingle drives Poisson processes over its
weight axis, cut hierarchically into [0, 1), [1, 2), [2, 4), [4, 8) ...  A text
in which the shingle occurs ``w`` times sees the points below ``w``; each point
falls into a random component, which keeps its earliest point.  Two texts agree
in a component with probability equal to their weighted Jaccard similarity.

Texts with equal fingerprint are one node.  Bands of signature components give
bucket keys.  In every bucket each node is compared with the bucket's leader;
then, in buckets that still hold different classes, the nodes outside the
leader's class are compared with all others by sketches of the signatures, block
by block inside tasks.  Multiset overlap of every remaining pair is computed
exactly.  The leader is the node that meets most others: copies of a text differ
from each other more than from it.

Words are runs between white space, compared as they stand.  A text of 1 to 4
words is one shingle; null texts and texts without words are never duplicates
of each other.  Repeated rows share a class; a class is named by its smallest
``doc_id``.  A fingerprint is 64 bits wide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ember.llm.common import components, stored

WORDS = 5
COMPONENTS = 128
BANDS, ROWS = 40, 6
REMEMBERED = 600_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling (wraps around by design)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        got = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest(), "little")
        return got


def shingle_bags(texts: list[str | None], known: WordHash, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ``(text number, shingle, count)`` of a batch of whole texts."""
    if len(known) > REMEMBERED:
        known.clear()
    hashed = []
    for text in texts:
        split = text.split() if text else []
        hashed.append(np.fromiter(map(known.__getitem__, split), U, len(split)))
    sizes = np.array([len(h) for h in hashed], dtype=np.int64)
    flat = np.concatenate(hashed) if hashed else np.zeros(0, U)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    factors = mix(np.arange(1, words + 1, dtype=U))
    with np.errstate(over="ignore"):
        total = np.zeros(len(flat), U)
        inside = np.arange(len(flat)) + words <= ends[owner] if len(flat) else np.zeros(0, bool)
        for j in range(words):
            total += np.concatenate([flat[j:], np.zeros(min(j, len(flat)), U)]) * factors[j]
        short = np.flatnonzero((sizes > 0) & (sizes < words))
        tails = [mix(mix(hashed[i]) * factors[: sizes[i]]).sum(dtype=U) + U(sizes[i]) for i in short]
        shingle = np.concatenate([mix(total[inside]), np.array(tails, dtype=U)])
    owner = np.concatenate([owner[inside], short])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(first)
    return owner[at], shingle[at], np.diff(np.append(at, len(owner)))


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """Earliest point per component, ``n`` rows of ``m`` arrival times."""
    out = np.full(n * m, np.inf)
    weight = np.bincount(owner, weights=count, minlength=n)
    todo = np.unique(owner)
    limit = np.zeros(n)
    limit[todo] = m * (np.log(m) + 4) / weight[todo]
    while len(todo):
        chosen = np.isin(owner, todo)
        o, s, c = owner[chosen], shingle[chosen], count[chosen].astype(np.int64)
        level = 0
        while len(o):
            # weight interval [0, 1) at level 0, then [2 ** (k - 1), 2 ** k)
            low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            with np.errstate(over="ignore"):
                seed = mix(s + U(level + 1) * U(0x9E3779B97F4A7C15))
            own, weight_of, time, step = o, c, np.zeros(len(o)), 0
            while len(own):
                step += 1
                with np.errstate(over="ignore"):
                    bits = mix(seed + U(step) * U(0xD1342543DE82EF95))
                    more = mix(bits ^ U(0x2545F4914F6CDD1D))
                time = time - np.log(((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
                live = time < limit[own]
                own, weight_of, time, seed, more = own[live], weight_of[live], time[live], seed[live], more[live]
                at = low + ((more & U(0xFFFFFFFF)).astype(np.int64) * width >> 32)
                seen = at < weight_of
                np.minimum.at(out, own[seen] * m + ((more[seen] >> U(32)) * U(m) >> U(32)).astype(np.int64), time[seen])
            deeper = c > low + width
            o, s, c = o[deeper], s[deeper], c[deeper]
            level += 1
        todo = todo[np.isinf(out.reshape(n, m)[todo]).any(axis=1)]
        limit[todo] *= 2
    return out.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; a band takes ``rows`` components of a fixed shuffle."""
    rng = np.random.default_rng(11)
    m = signature.shape[1]
    chosen = np.concatenate([rng.permutation(m) for _ in range(-(-bands * rows // m))])[: bands * rows].reshape(bands, rows)
    bits = signature.view(U)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), (len(signature), bands)).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + bits[:, chosen[:, j]])
    return key.view(np.int64)


def _slices(sizes: list[int], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows with a bounded number of characters (a longer text stands alone)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def sketches(signature: np.ndarray) -> np.ndarray:
    """One byte per component; bytes of two texts agree about as often as their components."""
    return (mix(signature.view(U)) & U(255)).astype(np.uint8)


def signed(docs: DataFrame) -> DataFrame:
    """``node, n`` (shingles), band keys and sketch of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices([len(t or "") for t in texts]):
                owner, shingle, count = shingle_bags(texts[a:b], known)
                n = b - a
                total = np.bincount(owner, weights=count, minlength=n).astype(np.int64)
                signature = signatures(owner, shingle, count, n)
                keys, sketch = band_keys(signature), pa.array([r.tobytes() for r in sketches(signature)], pa.binary())
                full = pa.array(np.flatnonzero(total))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n).take(full), batch.column("node").slice(a, n).take(full), pa.array(total[total > 0]), lists.take(full), sketch.take(full)],
                    ["doc_id", "node", "n", "bands", "sketch"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("node"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, node bigint, n bigint, bands array<bigint>, sketch binary")


def overlap(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``u, v`` whose exact multiset similarity reaches ``threshold``.

    ``texts`` has one text per node.  Both joins are on single nodes and split
    by adaptive execution where one node has many partners.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for x, y in _slices([len(s) + len(t) for s, t in zip(left, right, strict=True)]):
                n = y - x
                owner, shingle, count = shingle_bags(left[x:y] + right[x:y], known)
                total = np.bincount(owner, weights=count, minlength=2 * n)
                pair = owner % n
                order = np.lexsort((shingle, pair))
                pair, shingle, count = pair[order], shingle[order], count[order]
                both = np.flatnonzero((pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1]))
                common = np.bincount(pair[both], weights=np.minimum(count[both], count[both + 1]), minlength=n)
                alike = common >= threshold * (total[:n] + total[n:] - common) - 1e-9
                yield pa.RecordBatch.from_arrays([batch.column("u").slice(x, n), batch.column("v").slice(x, n), pa.array(alike)], ["u", "v", "alike"])

    a = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    joined = pairs.select("u", "v").join(b, "v").join(a, "u").select("u", "v", "a", "b")
    return joined.mapInArrow(run, "u bigint, v bigint, alike boolean")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Class of every document: ``doc_id, node, class_id`` (smallest ``doc_id`` of the class) and ``root``.

    Classes are the connected components of texts whose similarity reaches
    ``threshold``.  ``root`` tells apart classes whose smallest ``doc_id`` is the
    same because an id stands at several texts; it is null for texts without words,
    which are classes of their own.
    """
    rows = stored(signed(docs), "signed")
    reps = rows.groupBy("node").agg(F.min("doc_id").alias("rep")).withColumnRenamed("node", "_node")
    # one row per text: repeats of a text carry the same bands
    single = rows.join(reps, (F.col("node") == F.col("_node")) & F.col("rep").eqNullSafe(F.col("doc_id"))).select("node", "rep", "n", "bands", "sketch")
    nodes = stored(single.dropDuplicates(["node"]), "nodes")
    buckets = nodes.select("node", "n", F.explode("bands").alias("key"))
    crowds = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").select(F.col("key").alias("_key"), "_size")
    shared = stored(buckets.join(crowds, F.col("key") == F.col("_key")).select("key", "node", "n", "_size"), "shared")
    # the text that meets most others leads: copies of one text differ from each other more than from it
    fame = shared.groupBy("node").agg(F.sum("_size").alias("fame")).withColumnRenamed("node", "_node")
    famed = shared.join(fame, F.col("node") == F.col("_node"))
    heads = famed.groupBy("key").agg(F.max(F.struct("fame", "node", "n")).alias("_head")).withColumnRenamed("key", "_key")
    shared = stored(shared.join(heads, F.col("key") == F.col("_key")).select("key", "node", "n", F.col("_head.node").alias("head"), F.col("_head.n").alias("head_n")), "shared")
    near_in_size = F.least("n", "head_n") >= threshold * F.greatest("n", "head_n") - 1e-9
    pairs = shared.where((F.col("node") != F.col("head")) & near_in_size).groupBy(F.col("head").alias("u"), F.col("node").alias("v")).agg(F.lit(1).alias("_1")).select("u", "v")

    candidates = shared.groupBy("node").agg(F.lit(1).alias("_1")).select(F.col("node").alias("_node"))
    candidates = candidates.join(nodes.select("node", "rep"), F.col("_node") == F.col("node")).select("_node", F.col("rep").alias("_rep"))
    named = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("node"))
    texts = named.join(candidates, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_rep"))).select("node", "text")
    texts = stored(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    tried = stored(overlap(pairs, texts, threshold), "pairs")
    edges = tried.where("alike").select("u", "v")
    labels = components(edges)
    more = stored(_late_links(shared, labels, nodes, texts, threshold), "late")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))

    classes = nodes.join(labels.withColumnRenamed("u", "_u"), F.col("node") == F.col("_u"), "left").withColumn("_root", F.coalesce("root", "node"))
    names = classes.groupBy("_root").agg(F.min("rep").alias("class_id"))
    classes = stored(classes.join(names, "_root").select(F.col("node").alias("_node"), "class_id", F.col("_root").alias("root")), "classes")
    every = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("node"))
    out = every.join(classes, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), "root")


def _labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    known = labels.select(F.col("u").alias("_u"), F.col("root").alias("_root"))
    return rows.join(known, F.col(node) == F.col("_u"), "left").withColumn(name, F.coalesce("_root", node)).drop("_u", "_root")


def _late_links(shared: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, strangers: int = 256, members: int = 1024) -> DataFrame:
    """Links ``u, v`` between different classes among nodes that share a bucket.

    Nodes of the buckets of one leader form a group; its strangers are those
    outside the leader's class.  Of two nodes of different classes one is a
    stranger, so strangers meet all members, in blocks of about ``strangers`` by
    ``members`` rows, however large the group.  Inside a task pairs whose
    sketches agree to within 4.2 standard deviations of the threshold are
    compared exactly.  Only links that join two classes of the block are sent
    on, fewer than the block has nodes; pairs never become rows.
    """
    rows = shared.groupBy("head", "node").agg(F.max("n").alias("n"))
    rows = _labelled(_labelled(rows, labels, "node", "root"), labels, "head", "head_root")
    size = rows.groupBy("head").agg(F.count(F.lit(1)).alias("_m"), F.sum((F.col("root") != F.col("head_root")).cast("bigint")).alias("_s")).where("_s > 0 and _m > 2")
    size = stored(size.select(F.col("head").alias("_head"), F.ceil(F.col("_s") / strangers).cast("int").alias("sp"), F.ceil(F.col("_m") / members).cast("int").alias("mp"), "_m"), "sizes")
    total = size.agg(F.coalesce(F.sum("_m"), F.lit(0))).first()[0]
    groups = max(1, -(-total // members))  # small groups share a task
    whole = nodes.select(F.col("node").alias("_node"), "sketch").join(texts.select(F.col("node").alias("_text_node"), "text"), F.col("_node") == F.col("_text_node")).drop("_text_node")
    rows = rows.join(size, F.col("head") == F.col("_head")).join(whole, F.col("node") == F.col("_node"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("node", "head"), F.col(c)).cast("int")
    group = F.pmod(F.xxhash64("head"), F.lit(groups)).cast("int")
    held = ("head", "node", "n", "root", "sketch", "text")
    left = rows.where("root <> head_root").select(group.alias("g"), part("sp").alias("a"), every("mp").alias("b"), *held)
    right = rows.select(group.alias("_g"), part("mp").alias("_b"), every("sp").alias("_a"), *[F.col(c).alias(f"_{c}") for c in held])
    agree = COMPONENTS * threshold - 4.2 * np.sqrt(COMPONENTS * threshold * (1 - threshold))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if one.num_rows and two.num_rows:
            known = WordHash()
            heads, others = one.column("head").to_numpy(), two.column("_head").to_numpy()
            for head in np.unique(heads):
                links += _block_links(one.filter(pa.array(heads == head)), two.filter(pa.array(others == head)), threshold, agree, known)
        return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})

    return left.groupBy("g", "a", "b").cogroup(right.groupBy("_g", "_a", "_b")).applyInArrow(run, "u bigint, v bigint").distinct()


def _block_links(one: pa.Table, two: pa.Table, threshold: float, agree: float, known: WordHash) -> list[tuple[int, int]]:
    """Links that join classes of one block of strangers and members."""
    if not one.num_rows or not two.num_rows:
        return []
    columns = []
    for t, own in ((one, ""), (two, "_")):
        bits = np.frombuffer(b"".join(t.column(f"{own}sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        columns.append([t.column(f"{own}{c}").to_numpy() for c in ("node", "n", "root")] + [bits])
    (x, nx, rx, bx), (y, ny, ry, by) = columns
    owner, shingle, count = shingle_bags(one.column("text").to_pylist() + two.column("_text").to_pylist(), known)
    # the k-th occurrence of a shingle is an element of its own
    with np.errstate(over="ignore"):
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        element = np.unique(mix(np.repeat(shingle, count) + nth.astype(U) * U(0x9E3779B97F4A7C15)), return_inverse=True)[1]
    size = np.bincount(owner, weights=count, minlength=len(x) + len(y)).astype(np.int64)
    start = np.cumsum(size) - size
    mark, parent, links = np.zeros(len(element), bool), {}, []

    def root(r: int) -> int:
        while parent.get(r, r) != r:
            r = parent[r]
        return r

    for i in range(len(x)):
        at = np.flatnonzero((ry != rx[i]) & (np.minimum(ny, nx[i]) >= threshold * np.maximum(ny, nx[i]) - 1e-9))
        at = at[(by[at] == bx[i]).sum(axis=1) >= agree]
        at = at[[root(int(r)) != root(int(rx[i])) for r in ry[at]]] if len(at) else at
        if not len(at):
            continue
        own = element[start[i] : start[i] + size[i]]
        mark[own] = True
        sizes = size[len(x) + at]
        inside = np.repeat(start[len(x) + at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        common = np.add.reduceat(mark[element[inside]].astype(np.int64), np.cumsum(sizes) - sizes)
        mark[own] = False
        for j in at[common >= threshold * (nx[i] + ny[at] - common) - 1e-9]:
            a, b = root(int(rx[i])), root(int(ry[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(x[i]), int(y[j])))
    return links


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of every near-duplicate class.

    Of every class the row with the smallest ``doc_id`` stays, rows without an id
    after all others; of equal ids the smallest text hash, of fully repeated rows
    one.  Texts without words are classes of their own per ``doc_id``, and kept
    if they have none.
    """
    rows = near_duplicates(docs, threshold).groupBy("root", "node", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    # texts without words: one row per id, all without id
    single = F.when(F.col("root").isNull(), F.struct("node", "doc_id"))
    rows = rows.withColumn("rows", F.when(F.col("root").isNull() & F.col("doc_id").isNull(), 1).otherwise(F.col("rows")))
    first = rows.groupBy("root", single.alias("single")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "rows")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("__id"), F.col("f.node").alias("__node"), F.col("f.rows").alias("__rows"))
    kept = docs.join(first, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__node")))
    once = kept.where(F.col("__rows") == 1).select(*[docs[c] for c in docs.columns])
    several = kept.where(F.col("__rows") > 1).dropDuplicates(["__id", "__node"]).select(*[docs[c] for c in docs.columns])
    return once.unionByName(several)
