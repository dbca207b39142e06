"""Hard-negative mining by ball trees: exact inner products, branch and bound.

Rows are dealt into pieces that fit in memory and anchors into blocks; every block meets
every piece, so nothing is broadcast and a task holds one piece and one block. A piece
becomes a ball tree, whose upper levels part the labels. With centre c and radius r of a
ball, the inner product of an anchor q with any row in it lies between q.c - |q|r and
q.c + |q|r: a ball is passed over if that lies outside of the window of scores that is asked
for, or strictly beneath the anchor's current kth score (at the kth score itself a row with a
smaller id may still come in). Anchors go down a tree together, each with its own kth score.
Scores are whole numbers and exact.

The search runs twice: for the best rows of an anchor's own label, its positives, and then,
with a window for each positive, for the best rows of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.llm.common import cut
from orrery.llm.whitening import whole_numbers

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Numbers of a piece's vectors, anchors in a block, rows in a leaf.
PIECE_NUMBERS, BLOCK, LEAF = 1 << 20, 4096, 128
LEAST, MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


class BallTree:
    """Rows ``x`` in the order of the tree; nodes with bounds, centres, radii and labels."""

    def __init__(self, x: np.ndarray, label: np.ndarray, row_id: np.ndarray, leaf: int = LEAF):
        order = np.argsort(label, kind="stable")
        points = x[order].astype(float)
        label = label[order]
        at = np.arange(len(x))
        self.spans, self.children, centres, self.radii = [(0, len(x))], [None], [], []
        node = 0
        while node < len(self.spans):
            a, b = self.spans[node]
            here = points[at[a:b]]
            centre = here.mean(axis=0)
            centres.append(centre)
            away = ((here - centre) ** 2).sum(axis=1)
            self.radii.append(np.sqrt(away.max()))
            half = self._labels_apart(label[at[a:b]]) if b - a > leaf or label[at[a]] != label[at[b - 1]] else 0
            if not half and b - a > leaf:
                half = (b - a) // 2
                far = here[away.argmax()]
                other = here[((here - far) ** 2).sum(axis=1).argmax()]
                at[a:b] = at[a:b][np.argpartition(here @ (other - far), half)]
            if half:
                self.children[node] = (len(self.spans), len(self.spans) + 1)
                self.spans += [(a, a + half), (a + half, b)]
                self.children += [None, None]
            node += 1
        order = order[at]
        self.centres, self.radii = np.array(centres), np.array(self.radii)
        self.x, self.label, self.row_id = x[order], label[at], row_id[order]
        #: Labels are in order between nodes and within one label there is only that one.
        self.labels = [(self.label[a], self.label[b - 1]) for a, b in self.spans]

    @staticmethod
    def _labels_apart(label: np.ndarray) -> int:
        """The change of label that is nearest to the middle; 0 if there is but one label."""
        changes = np.flatnonzero(np.diff(label)) + 1
        return int(changes[np.abs(changes - len(label) // 2).argmin()]) if len(changes) else 0


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("a score may exceed a long")
    return q @ x.T


def search(tree: BallTree, q: np.ndarray, label: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
    """Scores and ids (``LEAST`` where there are fewer) of the first ``k`` rows of each query, and how many scores were computed.

    ``same`` asks for rows of the query's label but not its id, else for rows of other labels.
    """
    m = len(q)
    scores, ids = np.full((m, k), LEAST), np.full((m, k), MOST)
    length, near = np.sqrt((q.astype(float) ** 2).sum(axis=1)), q.astype(float)
    stack, computed = [(0, np.arange(m))], 0
    while stack:
        node, act = stack.pop()
        first, last = tree.labels[node]
        act = act[(first <= label[act]) & (label[act] <= last)] if same else act[(label[act] != first) | (label[act] != last)]
        middle, reach = near[act] @ tree.centres[node], length[act] * tree.radii[node]
        reach += 1e-9 * (np.abs(middle) + reach + 1)  # rounding
        kth = scores[act, -1]
        act = act[(middle + reach >= np.maximum(low[act], kth)) & (middle - reach <= high[act])]
        if not len(act):
            continue
        if tree.children[node]:
            left, right = tree.children[node]
            if near[act].mean(axis=0) @ (tree.centres[left] - tree.centres[right]) > 0:
                left, right = right, left
            stack += [(left, act), (right, act)]  # the likelier child first
            continue
        a, b = tree.spans[node]
        found = products(q[act], tree.x[a:b])
        computed += found.size
        fits = (found >= np.maximum(low[act], scores[act, -1])[:, None]) & (found <= high[act, None])
        if same:
            fits &= (tree.label[a:b] == label[act, None]) & (tree.row_id[a:b] != own[act, None])
        else:
            fits &= tree.label[a:b] != label[act, None]
        some = fits.any(axis=1)
        act, found, fits = act[some], found[some], fits[some]
        s = np.concatenate([scores[act], np.where(fits, found, LEAST)], axis=1)
        i = np.concatenate([ids[act], np.where(fits, tree.row_id[a:b], MOST)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        scores[act], ids[act] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    return scores, ids, computed


def _vectors(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat numbers, starts and lengths of an Arrow list column."""
    column = column.combine_chunks()
    ends = column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column) else 0)
    return column.flatten().to_numpy(), ends[:-1], np.diff(ends)


def _groups(rows, queries) -> Iterator[tuple]:
    """Tree of the rows, vectors and places of the queries, for each length that both have."""
    flat, starts, sizes = _vectors(rows.column("x"))
    q_flat, q_starts, q_sizes = _vectors(queries.column("x"))
    label, row_id = rows.column("label").to_numpy(), rows.column("vec_id").to_numpy()
    for d in np.intersect1d(sizes, q_sizes):
        r, q = np.flatnonzero(sizes == d), np.flatnonzero(q_sizes == d)
        span = np.arange(d)
        yield BallTree(flat[starts[r, None] + span], label[r], row_id[r]), q_flat[q_starts[q, None] + span], q


POSITIVE_SCHEMA = "anchor_id long, anchor_key long, score long, found long"


def _positives(k: int):
    def run(rows, queries):
        out = [[] for _ in range(4)]
        if not rows.num_rows or not queries.num_rows:  # an empty side has no columns
            return _table(POSITIVE_SCHEMA, out)
        names, keys, label = (queries.column(c).to_numpy() for c in ("vec_id", "anchor_key", "label"))
        for tree, q, place in _groups(rows, queries):
            low, high = np.full(len(q), LEAST), np.full(len(q), MOST)
            scores, ids, _ = search(tree, q, label[place], names[place], low, high, True, k)
            i, j = np.nonzero(scores > LEAST)
            for column, values in zip(out, (names[place][i], keys[place][i], scores[i, j], ids[i, j]), strict=True):
                column.append(values)
        return _table(POSITIVE_SCHEMA, out)

    return run


NEGATIVE_SCHEMA = "anchor_id long, anchor_key long, nth long, positive_id long, positive_score long, score long, found long"


def _negatives(k: int, low: int, high: int):
    def run(rows, queries):
        out = [[] for _ in range(7)]
        if not rows.num_rows or not queries.num_rows:
            return _table(NEGATIVE_SCHEMA, out)
        names, keys, label = (queries.column(c).to_numpy() for c in ("vec_id", "anchor_key", "label"))
        asked = queries.column("positives").combine_chunks()
        ends = asked.offsets.to_numpy() - (asked.offsets[0].as_py() if len(asked) else 0)
        positives = asked.flatten()
        nth, ids_of, scores_of = (positives.field(i).to_numpy() for i in range(3))
        for tree, q, place in _groups(rows, queries):
            times = np.diff(ends)[place]
            who = np.repeat(np.arange(len(place)), times)
            which = np.concatenate([np.arange(ends[p], ends[p + 1]) for p in place])
            at = scores_of[which]
            scores, ids, _ = search(tree, q[who], label[place][who], names[place][who], -(-low * at // 100), high * at // 100, False, k)
            i, j = np.nonzero(scores > LEAST)
            p, w = place[who[i]], which[i]
            for column, values in zip(out, (names[p], keys[p], nth[w], ids_of[w], scores_of[w], scores[i, j], ids[i, j]), strict=True):
                column.append(values)
        return _table(NEGATIVE_SCHEMA, out)

    return run


def _table(schema: str, columns: list[list[np.ndarray]]):
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]
    return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for n, c in zip(names, columns, strict=True)})


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, numbers: int = PIECE_NUMBERS, block: int = BLOCK) -> DataFrame:
    """Hard negatives of each anchor and positive among ``rows (vec_id, label, x, anchor)``.

    ``x`` holds whole numbers; rows with ``anchor`` true are the queries, against all rows.
    An anchor's positives are its first rows of the same label and another id, by falling
    score, then by id; for each, the first rows of other labels whose score is between ``low``
    and ``high`` percent of the positive's are returned with their ``rank``. Positives with a
    score beneath zero have no such rows. Rows with a null in any of the four columns take no
    part. Exact repeats of a row count once; rows that share an id but differ in label or
    vector are rows of their own, and anchors of their own. Only vectors of equal length are
    compared. Scores that exceed a long raise OverflowError. Other columns are not looked at.
    An empty table, or one without anchors, gives no rows.
    """
    fields = ["vec_id", "label", "x"]
    held = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "x", "anchor").dropna()
    held = cut(held.groupBy(*fields).agg(F.max("anchor").alias("anchor")))
    size = held.agg(F.sum(F.size("x")).alias("numbers"), F.count_if("anchor").alias("anchors")).first()
    n_pieces = max(1, -(-(size["numbers"] or 0) // numbers))
    n_blocks = max(1, -(-size["anchors"] // block))
    own = F.xxhash64("label", "x")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = held.select(*fields, F.pmod(F.xxhash64(*fields), F.lit(n_pieces)).alias("piece"), each(n_blocks).alias("block"))

    def asked(queries: DataFrame, *beside: str) -> DataFrame:
        placed = queries.select(*fields, *beside, F.pmod(F.xxhash64(*fields, F.lit(1)), F.lit(n_blocks)).alias("block"))
        return placed.withColumn("piece", each(n_pieces))

    def met(queries: DataFrame, run, schema: str) -> DataFrame:
        return dealt.groupBy("piece", "block").cogroup(queries.groupBy("piece", "block")).applyInArrow(run, schema)

    def first(found: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "found")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    anchors = held.filter("anchor").select(*fields, own.alias("anchor_key"))
    best = first(met(asked(anchors, "anchor_key"), _positives(positives), POSITIVE_SCHEMA), positives, "anchor_id", "anchor_key")
    nth = F.struct(F.col("rank").cast("long").alias("nth"), F.col("found").alias("id"), "score")
    wanted = best.groupBy(F.col("anchor_id").alias("vec_id"), "anchor_key").agg(F.collect_list(nth).alias("positives"))
    queries = cut(anchors.join(wanted, ["vec_id", "anchor_key"]))
    found = met(asked(queries, "anchor_key", "positives"), _negatives(negatives, low, high), NEGATIVE_SCHEMA)
    out = first(found, negatives, "anchor_id", "anchor_key", "nth")
    return out.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(embeddings: DataFrame) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; labels of ids divisible by 7 go up by one, modulo 10."""
    rows = whole_numbers(embeddings.select("vec_id", "label", "embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), F.col("__x").alias("x"), (F.col("vec_id") % 100 == 0).alias("anchor")))


#: The same rows in DuckDB: every anchor against all rows.
SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
