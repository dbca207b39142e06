"""Near-duplicates by fast similarity sketching, banding and exact verification.

A text's set is its distinct shingles of five words. The sketch throws every element
into one of its bins by a fresh hash in each round, for up to ``bins`` rounds, and then
forces one bin a round, so that every bin fills; earlier rounds win, so two sets agree
in a bin with probability equal to their similarity, with bounds as sharp as those of
independent minima. Bands of bins make buckets.

Equal sets first become one class, so any number of copies is one node from then on.
Buckets that share a class chain together into clusters, and a cluster's full sets are sent
to one place, once, where all its pairs are compared as products of matrices. A cluster
beyond a block's size is cut into blocks. Each block has the cluster's most central sets
(those whose buckets are the largest: the least edited copies) as guests, which links what
is close to them; then only sets outside the cluster's largest component go through the
other blocks, so a group of n lightly edited copies costs n comparisons with its centres,
and no pair of different components is left out. Links are confirmed on the full sets, and
components are found by passing on the smallest node with pointer jumping. Nothing is
gathered on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.llm.common import cut, join_listed, per_text, weigh

WIDTH, BINS, ROWS, PERCENT = 5, 128, 4, 75
#: Sets, and shingles in them, that a block holds on average; central sets that visit each block of their cluster.
BLOCK_SETS, BLOCK_SHINGLES, CENTRES = 1024, 1 << 21, 8
#: Small clusters are compared together, so many sets in a task's group on average.
BIN_SETS = 2048
SKETCH_SCHEMA = "n_shingles long, k1 long, k2 long, bands array<long>"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change
    if not words:
        return np.zeros(0, np.uint64)
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(out))
    total = np.full(len(out) - size + 1, size, np.uint64)
    for j in range(size):
        total = mix(total * _GOLD + out[j : len(out) - size + 1 + j])
    return np.unique(total)


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The sketch of a non-empty set; ``bins`` is a power of two."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    shift, low = np.uint64(64 - (bins.bit_length() - 1)), np.uint64((1 << 52) - 1)
    done = 0
    while done < bins and (out == np.iinfo(np.uint64).max).any():
        # Later rounds never displace earlier ones, so a few at a time do no harm.
        rounds = np.arange(done, min(bins, done + max(1, 3 * bins // len(items))), dtype=np.uint64)
        x = mix(items[None, :] + (rounds[:, None] + np.uint64(1)) * _GOLD)
        np.minimum.at(out, (x >> shift).ravel(), ((rounds[:, None] << np.uint64(52)) | (x & low)).ravel())
        done += len(rounds)
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        x = mix(items + np.array([bins + int(b) + 1], np.uint64) * _GOLD)
        out[b] = (np.uint64(bins + int(b)) << np.uint64(52)) | (x & low).min()
    return out


def band_keys(sketched: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sketched.reshape(-1, rows)
    total = np.arange(len(parts), dtype=np.uint64)
    for j in range(rows):
        total = mix(total * _GOLD + parts[:, j])
    return total.astype(np.int64)


def set_key(items: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums by which equal sets are known."""
    return len(items), int(items.sum().astype(np.int64)), int(mix(items + _GOLD).sum().astype(np.int64))


def sketched(docs: DataFrame, width: int, bins: int, rows: int, *beside: str) -> DataFrame:
    def make():
        def one(text: str | None) -> tuple:
            items = shingles(text, width)
            return *set_key(items), band_keys(sketch(items, bins), rows) if len(items) else []

        return lambda texts: [*map(one, texts)]

    return per_text(docs, SKETCH_SCHEMA, make, *beside)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def make():
        def one(text: str | None) -> tuple:
            items = shingles(text, width)
            return *set_key(items), items.astype(np.int64)

        return lambda texts: [*map(one, texts)]

    return per_text(docs, "n_shingles long, k1 long, k2 long, items array<long>", make)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes in ``edges (a, b)``: label is the smallest node reachable."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = cut(labels.withColumn("label", F.least("node", "label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("label")
        )
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("above"))
        jumped = lower.join(roots, F.col("label") == F.col("root"), "left").select(
            "node", "old", F.least("label", F.coalesce("above", "label")).alias("label")
        )
        jumped = cut(jumped)
        labels = jumped.select("node", "label")
        if jumped.filter("label < old").isEmpty():
            return labels


def linked_pairs(sets: list[np.ndarray], percent: int, rows: np.ndarray | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """Pairs of sets that have a link, each but once: of ``rows`` (all, if none are named) with any later or unnamed one.

    With labels, only pairs of different ones. All intersections are counted at a time, as products of matrices.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    rows = np.arange(m) if rows is None else rows
    owner = np.repeat(np.arange(m), sizes)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # what only one set has is in no intersection
    owner, col = owner[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    named = np.full(m, -1)
    named[rows] = np.arange(len(rows))
    width, tall = int(shared.sum()), max(1, (1 << 23) // m)
    wide = max(64, (1 << 22) // m)
    out = [np.zeros((0, 2), np.int64)]
    for top in range(0, len(rows), tall):
        mine = rows[top : top + tall]
        both = np.zeros((len(mine), m), np.float32)  # whole numbers below 2**24: exact
        for left in range(0, width, wide):
            a, b = np.searchsorted(col, [left, left + wide])
            part = np.zeros((m, min(wide, width - left)), np.float32)
            part[owner[a:b], col[a:b] - left] = 1
            both += part[mine] @ part.T
        both = both.astype(np.int64)
        close = both * 100 >= percent * (sizes[mine, None] + sizes - both)
        if label is not None:
            close &= label[mine, None] != label
        x, y = np.nonzero(close)
        x = mine[x]
        once = np.where(named[y] >= 0, named[x] < named[y], True) & (x != y)
        out.append(np.stack([x[once], y[once]], axis=1))
    return np.concatenate(out)


def spanning(nodes: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """As few of the pairs (of places in ``nodes``) as connect what they connect."""
    above = np.arange(len(nodes)).tolist()

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    for x, y in pairs.tolist():
        a, b = top(x), top(y)
        if a != b:
            above[b] = a
            out.append((int(nodes[x]), int(nodes[y])))
    return out


EDGE_SCHEMA = "a long, b long"


def _compare(percent: int):
    """Links within the clusters of a group; where it names guests, only those of guests."""

    def run(table):
        import pyarrow as pa

        cluster, node, guest, label = (table.column(k).to_numpy() for k in ("cluster", "node", "guest", "label"))
        items = table.column("items").combine_chunks()
        flat, ends = items.flatten().to_numpy(), items.offsets.to_numpy() - items.offsets[0].as_py()
        # A set that is at home in a block may also be its guest; it then counts as a guest.
        order = np.lexsort((~guest, node, cluster))
        order = order[np.concatenate([[True], (np.diff(node[order]) != 0) | (np.diff(cluster[order]) != 0)])]
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            sets = [flat[ends[i] : ends[i + 1]] for i in part]
            again = label[part].any()  # labels are named where only guests are compared
            pairs = linked_pairs(sets, percent, np.flatnonzero(guest[part]), label[part]) if again else linked_pairs(sets, percent)
            out += spanning(node[part], pairs)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links ``a, b`` that connect all ``classes (node, rep, n_shingles, bands)`` of a component."""
    members = classes.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).filter("size > 1")
    met = members.join(buckets, "band").groupBy("node").agg(F.sum("size").alias("weight"), F.collect_set("first").alias("firsts"))
    met = cut(met.withColumn("hub", F.array_min("firsts")))
    # A class goes to the least of its buckets' firsts, and its other firsts go there too. Large
    # groups share their firsts, so these links are about as many as classes, not as buckets they are in.
    chained = met.select(F.explode("firsts").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = components(met.select(F.col("node").alias("a"), F.col("hub").alias("b")).union(chained).filter("a <> b"))
    placed = clusters.withColumnRenamed("label", "cluster").join(met.select("node", "weight"), "node").join(classes.select("node", "rep", "n_shingles"), "node")
    placed = cut(placed)
    of = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("m") / BLOCK_SHINGLES)).alias("blocks")
    placed = placed.join(of.select("cluster", blocks), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = cut(placed)

    ids = placed.select(F.col("rep").alias("doc_id")).distinct()
    texts = join_listed(docs.select("doc_id", "text"), ids, "doc_id", "left_semi", weigh(ids)[1])
    sets = full_sets(texts, width).select(node_of().alias("node"), "items")
    sets = cut(sets.join(placed.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    def compared(sent: DataFrame) -> DataFrame:
        fields = ["key", "part", "cluster", "node", "guest", "label"]
        return sent.select(*fields).join(sets, "node").groupBy("key", "part").applyInArrow(_compare(percent), EDGE_SCHEMA)

    held = placed.agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m")).first()
    n_bins = max(1, held["n"] // BIN_SETS, (held["m"] or 0) // BLOCK_SHINGLES)
    small = placed.filter("blocks = 1").withColumns(
        {"key": F.pmod(F.xxhash64("cluster"), F.lit(n_bins)), "part": F.lit(-1).cast("long"), "guest": F.lit(False), "label": F.lit(0).cast("long")}
    )
    large = placed.filter("blocks > 1").withColumns({"key": F.col("cluster"), "label": F.lit(0).cast("long")})
    order = Window.partitionBy("cluster").orderBy(F.desc("weight"), "node")
    centres = large.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= CENTRES)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    first = large.withColumns({"part": F.col("block"), "guest": F.lit(False)})
    first = first.unionByName(centres.drop("nth").withColumn("part", every).withColumn("guest", F.lit(False)))
    edges = cut(compared(small.unionByName(first)))
    if large.isEmpty():
        return edges

    # What is not in its cluster's largest component goes through all blocks, as guests in groups of a block's size.
    labels = components(edges)
    large = large.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    large = cut(large)
    counted = large.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"))
    main = counted.groupBy("cluster").agg(F.max(F.struct("n", F.col("label").alias("main"))).alias("x"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    rest = F.greatest(F.col("n") - F.col("x.n"), F.lit(0))
    groups = F.greatest(F.ceil(rest / BLOCK_SETS), F.ceil(F.col("m") * rest / F.col("n") / BLOCK_SHINGLES)).alias("groups")
    large = cut(large.join(main.select("cluster", F.col("x.main").alias("main"), groups), "cluster").filter("groups > 0"))
    home = large.withColumns({"guest": F.lit(False), "group": F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))})
    guests = large.filter("label <> main").withColumns({"guest": F.lit(True), "group": F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")), "block": every})
    # A label of 0 would read as none.
    sent = home.unionByName(guests).withColumns({"part": F.col("block") * F.col("groups") + F.col("group"), "label": F.when(F.col("label") == 0, 1).otherwise(F.col("label"))})
    return cut(edges.unionByName(compared(sent)))


def node_of() -> F.Column:
    return F.xxhash64("n_shingles", "k1", "k2")


def judged(docs: DataFrame, width: int, percent: int, bins: int, rows: int, *beside: str) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, the columns ``beside``, ``n_shingles, component_id`` and ``group``, a component's own key."""
    every = cut(sketched(docs, width, bins, rows, *beside).withColumn("node", node_of()))
    usable = every.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(usable.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    labels = components(links(docs, classes, width, percent))
    least = labels.join(classes.select("node", "rep"), "node")
    least = least.join(least.groupBy("label").agg(F.min("rep").alias("least")), "label").select("node", "label", "least")
    found = classes.select("node", "rep").join(least, "node", "left")
    found = found.select("node", F.coalesce("least", "rep").alias("found"), F.coalesce("label", "node").alias("group"))
    out = every.drop("bands", "k1", "k2").join(found, "node", "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", *beside, "n_shingles", own.alias("component_id"), "group")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): set size, component and whether kept.

    Null and empty texts link with nothing. A text of fewer than ``width`` words is one
    shingle; texts of any length are taken whole. A null id links with nothing, and such rows
    are kept. Rows that share an id but not a text are nodes of their own, which both bear
    that id; repeated rows are one node and have equal results. Pairs exactly at ``percent``
    link. Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    out = judged(docs, width, percent, bins, rows).drop("group")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` without all but one of each group: that of the smallest id, then of the smallest hash.

    Rows are told apart by id and text, and of rows that agree in both one stays. Rows
    without an id or without words stay.
    """
    fields = docs.columns
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("__row"), "text")
    groups = cut(judged(keyed, width, percent, bins, rows, "__row").filter("doc_id is not null and n_shingles > 0"))
    kept = groups.groupBy("group").agg(F.min(F.struct("doc_id", "__row")).alias("x"))
    gone = groups.join(kept.select(F.col("x.__row").alias("__row")), "__row", "left_anti").select("__row").distinct()
    again = groups.groupBy("__row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__row")
    gone, again = cut(gone), cut(again.join(gone, "__row", "left_anti"))
    row = F.struct(*[F.col(f"`{c}`") for c in fields])
    held = docs.select(F.xxhash64("doc_id", "text").alias("__row"), row.alias("__all"))
    held = join_listed(held, gone, "__row", "left_anti", weigh(gone)[1])
    if not again.isEmpty():
        size = weigh(again)[1]
        one = join_listed(held, again, "__row", "left_semi", size).groupBy("__row").agg(F.first("__all").alias("__all"))
        held = join_listed(held, again, "__row", "left_anti", size).unionByName(one)
    return held.select(*[F.col("__all")[c].alias(c) for c in fields])


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


#: The same rows in DuckDB: all pairs that share a shingle, and their closure.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a),
c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""
