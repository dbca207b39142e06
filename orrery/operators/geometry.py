"""Coordinates: distances, alignment, pockets, medoids, clusters and diversity.

Neighbour searches bucket points by grid cell, so that only neighbouring cells meet.
Alignment and agglomerative clustering need linear algebra and run in grouped numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared(a: str, b: str) -> Column:
    """Squared distance between columns ``{a}x, {a}y, {a}z`` and ``{b}x, ...``."""
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"), F.lit(0.0))


def rmsd(pairs: DataFrame, keys: Sequence[str], a: str = "a_", b: str = "b_") -> DataFrame:
    return pairs.groupBy(*keys).agg(F.sqrt(F.avg(squared(a, b))).alias("rmsd"))


def affine(df: DataFrame, rotation: Sequence[Sequence[float]], shift: Sequence[float]) -> DataFrame:
    """Row vectors times ``rotation`` plus ``shift``."""
    out = {n: sum((F.col(c) * F.lit(float(rotation[i][j])) for i, c in enumerate("xyz")), F.lit(float(shift[j]))) for j, n in enumerate("xyz")}
    return df.withColumns(out)


#: Points of a block, about; rows of a block that meet another block at a time; pairs sent at a time; pairs of blocks in a task.
BLOCK, STRIP, SENT, PAIRS = 4096, 32, 1 << 18, 128


def blocks(points: DataFrame, group: Sequence[str], id_: str) -> DataFrame:
    """``block (group, piece), held``: the points of each group in blocks of about ``BLOCK`` points, by a hash of the id."""
    points = points.select(*group, F.col(id_).alias("id"), *"xyz")
    sizes = points.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__pieces")).select(*[F.col(g).alias(f"__g_{g}") for g in group], "__pieces")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    piece = F.pmod(F.xxhash64("id"), F.col("__pieces")).alias("piece")
    placed = points.join(sizes, same).select(F.struct(*group, piece).alias("block"), F.struct("id", *"xyz").alias("point"))
    return placed.groupBy("block").agg(F.collect_list("point").alias("held"))


def block_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``a_block, b_block, a_held, b_held`` for the blocks that ``pairs`` names, dealt evenly over the tasks."""
    spark = pairs.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS))
    out = pairs.join(left.select(F.col("block").alias("a_block"), F.col("held").alias("a_held")), "a_block")
    out = out.join(right.select(F.col("block").alias("b_block"), F.col("held").alias("b_held")), "b_block")
    return out.repartition(tasks, "a_block", "b_block")


def _sides(batch):
    """Ids and coordinates (NaN where null) of both blocks of each row."""
    columns = []
    for name in ("a_held", "b_held"):
        c = batch.column(batch.schema.get_field_index(name))
        columns.append((c.offsets.to_numpy(), c.values.field("id").to_numpy(zero_copy_only=False), [c.values.field(x) for x in "xyz"]))
    for i in range(batch.num_rows):
        sides = []
        for offsets, ids, xyz in columns:
            p, q = int(offsets[i]), int(offsets[i + 1])
            sides += [ids[p:q], [v[p:q].to_numpy(zero_copy_only=False) for v in xyz]]
        yield i, *sides


def _distances(a, b, p: int, q: int) -> np.ndarray:
    """Distances of rows p to q of ``a`` from all of ``b``, with each step as Spark takes it."""
    out = np.zeros((len(a[0][p:q]), len(b[0])))
    for u, v in zip(a, b, strict=True):
        d = u[p:q, None] - v[None, :]
        d *= d
        out += d
    return np.sqrt(out, out=out)


def _near(cutoff: float | None, kind):
    """Rows of pairs of blocks: ids of different points (within ``cutoff`` if given) and their distance; null for missing coordinates."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            groups = batch.column(batch.schema.get_field_index("group")) if "group" in batch.schema.names else None
            for i, ids, a, other, b in _sides(batch):
                step = max(1, SENT // max(1, len(other)))
                for p in range(0, len(ids), step):
                    d = _distances(a, b, p, p + step)
                    at, to = np.nonzero(d <= cutoff if cutoff is not None else ids[p : p + step, None] != other[None, :])
                    if not len(at):
                        continue
                    d = pa.array(d[at, to], from_pandas=True)
                    out = [pa.array(ids[p : p + step][at], kind), pa.array(other[to], kind), d]
                    if groups is not None:
                        out.insert(0, pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), groups[i : i + 1]).dictionary_decode())
                    yield pa.RecordBatch.from_arrays(out, names=[*(["group"] if groups is not None else []), "a", "b", "distance"])

    return run


def near_blocks(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """``block_pairs`` of ``a, a_x, a_y, a_z`` and ``b, b_x, ...`` that may hold points within ``cutoff``.

    Both sides are cut into cells as wide as the cutoff, and cells into blocks; blocks of neighbouring
    cells meet, so a crowded cell is shared by many tasks.
    """
    from orrery.operators.folds import checkpointed

    def cut(df, p):
        df = df.select(F.col(p).alias("id"), *[F.col(f"{p}_{c}").alias(c) for c in "xyz"])
        df = df.filter(" and ".join(f"abs({c}) < double('infinity')" for c in "xyz"))  # nothing is near a place that is null or NaN
        return checkpointed(blocks(df.withColumns({f"c{c}": F.floor(F.col(c) / cutoff) for c in "xyz"}), ["cx", "cy", "cz"], "id"))

    a, b = cut(left, "a"), cut(right, "b")
    here = a.select(F.col("block").alias("a_block"), *[F.col(f"block.c{c}").alias(f"c{c}") for c in "xyz"])
    there = b.select(F.col("block").alias("b_block"), *[F.col(f"block.c{c}").alias(f"c{c}") for c in "xyz"])
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for c in "xyz":
        there = there.withColumn("__d", F.explode(steps)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("__d")).drop("__d")
    return block_pairs(here.join(there, ["cx", "cy", "cz"]).select("a_block", "b_block"), a, b)


def near_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Pairs ``a, b, distance`` of ``a, a_x, a_y, a_z`` and ``b, b_x, ...`` within ``cutoff``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = left.schema["a"].dataType
    name = kind.simpleString()
    return near_blocks(left, right, cutoff).mapInArrow(_near(float(cutoff), to_arrow_type(kind)), f"a {name}, b {right.schema['b'].dataType.simpleString()}, distance double")


#: Of nearly equal distances the smaller id wins: ids over this are added to millionths of a distance.
TIE = 10_000_000


def _nearest(cutoff: float, clash: float, kind):
    """For each point ``a`` of a pair of blocks: contacts, clashes, the least distance, and the closest contact."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, ids, a, other, b in _sides(batch):
                out = []
                slack = 1e-8 + float(other.max() - other.min()) / TIE / 1e6
                for p in range(0, len(ids), STRIP):
                    d = _distances(a, b, p, p + STRIP)
                    contacts, clashes, least = (d <= cutoff).sum(axis=1), (d <= clash).sum(axis=1), d.min(axis=1)
                    at, to = np.nonzero((d <= np.minimum(least + slack, cutoff)[:, None]) & (contacts > 0)[:, None])
                    first = np.lexsort((other[to], np.floor(d[at, to] * 1e9 + 0.5) / 1e9 * 1e6 + other[to] / TIE, at))
                    at, to = at[first], to[first]
                    one = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                    at, to = at[one], to[one]
                    out.append((ids[p : p + STRIP][at], other[to], d[at, to], least[at], contacts[at], clashes[at]))
                x, y, far, least, contacts, clashes = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind), pa.array(y, kind), pa.array(far), pa.array(least), pa.array(contacts), pa.array(clashes)], names=["a", "b", "distance", "least", "contacts", "clashes"])

    return run


def nearest(left: DataFrame, right: DataFrame, cutoff: float, clash: float = 0.0) -> DataFrame:
    """``a, contacts, clashes, closest, least`` for each ``a`` with a ``b`` within ``cutoff``; ids are numbers.

    The closest partner has the least distance (at nine places) in millionths plus its id over ``TIE``. No pair leaves a task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = left.schema["a"].dataType
    name = kind.simpleString()
    found = near_blocks(left, right, cutoff).mapInArrow(_nearest(float(cutoff), float(clash), to_arrow_type(kind)), f"a {name}, b {name}, distance double, least double, contacts long, clashes long")
    key = F.floor(F.col("distance") * 1e9 + 0.5) / 1e9 * 1e6 + F.col("b") / TIE
    return found.groupBy("a").agg(F.sum("contacts").alias("contacts"), F.sum("clashes").alias("clashes"), F.min_by("b", F.struct(key, "b")).alias("closest"), F.min("least").alias("least"))


def within(df: DataFrame, group: str, id_: str) -> DataFrame:
    """``group, a, b, distance`` of the ordered pairs of different points in each group."""
    from pyspark.sql.pandas.types import to_arrow_type

    from orrery.operators.folds import checkpointed

    held = checkpointed(blocks(df.filter(F.col(group).isNotNull()), [group], id_))
    side = lambda p: held.select(F.col("block").alias(f"{p}_block"), F.col(f"block.{group}").alias("group"))
    pairs = block_pairs(side("a").join(side("b"), "group"), held, held)
    kind, name = df.schema[id_].dataType, df.schema[id_].dataType.simpleString()
    out = pairs.mapInArrow(_near(None, to_arrow_type(kind)), f"group {df.schema[group].dataType.simpleString()}, a {name}, b {name}, distance double")
    return out.withColumnRenamed("group", group)


def _sums(kind, group_kind):
    """For each point of either block of a pair: the sum of its distances to the points of the other, how many are known, and how many points have another id."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a_group, b_group, alone = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("a_g", "b_g", "alone"))
            for i, ids, a, other, b in _sides(batch):
                rows, down = np.zeros(len(ids)), np.zeros(len(other))
                fine, fine_b = (~np.isnan(s[0] + s[1] + s[2]) for s in (a, b))
                gaps = not (fine.all() and fine_b.all())
                for p in range(0, len(ids), STRIP):
                    d = _distances(a, b, p, p + STRIP)
                    if gaps:
                        d[np.isnan(d)] = 0.0
                    rows[p : p + STRIP] = d.sum(axis=1)
                    if not alone[i]:
                        down += d.sum(axis=0)
                known, known_b = np.where(fine, fine_b.sum(), 0), np.where(fine_b, fine.sum(), 0)
                met, met_b = np.full(len(ids), len(other)), np.full(len(other), len(ids))
                if alone[i] and len(np.unique(ids)) == len(ids):  # each point meets itself, at no distance
                    known, met = known - fine, met - 1
                else:
                    for x in np.flatnonzero(np.isin(ids, other)):  # the same id does not count
                        for y in np.flatnonzero(other == ids[x]):
                            ok = bool(fine[x] and fine_b[y])
                            d = float(np.sqrt(sum((u[x] - v[y]) ** 2 for u, v in zip(a, b, strict=True)))) if ok else 0.0
                            rows[x], known[x], met[x] = rows[x] - d, known[x] - ok, met[x] - 1
                            down[y], known_b[y], met_b[y] = down[y] - d, known_b[y] - ok, met_b[y] - 1
                sides = [(ids, a_group[i], b_group[i], rows, known, met), (other, b_group[i], a_group[i], down, known_b, met_b)]
                for names, g, h, sums, n, pairs in sides[: 1 if alone[i] else 2]:
                    of = lambda v: pa.array([v] * len(names), group_kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(names, kind), of(g), of(h), pa.array(sums), pa.array(n, pa.int64()), pa.array(pairs, pa.int64())], names=["a", "a_g", "b_g", "total", "known", "met"])

    return run


def distance_sums(points: DataFrame, group: str, id_: str, own: bool = False) -> DataFrame:
    """``a, a_g, b_g, total, known``: per point and group (its ``own`` only, if asked) the sum of its distances to points of another id, and their number.

    Blocks of points meet once for both sides, in tasks of even size; only sums leave a task.
    A group that holds no other point has no row.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    from orrery.operators.folds import checkpointed

    held = checkpointed(blocks(points.filter(F.col(group).isNotNull()) if own else points, [group], id_))
    side = lambda p: held.select(F.col("block").alias(f"{p}_block"), F.col(f"block.{group}").alias(f"{p}_g"))
    met = side("a").crossJoin(side("b")).filter("a_block <= b_block")
    pairs = block_pairs((met.filter("a_g = b_g") if own else met).withColumn("alone", F.col("a_block") == F.col("b_block")), held, held)
    kinds = [points.schema[c].dataType for c in (id_, group)]
    one, two = (k.simpleString() for k in kinds)
    found = pairs.mapInArrow(_sums(*map(to_arrow_type, kinds)), f"a {one}, a_g {two}, b_g {two}, total double, known long, met long")
    sums = found.groupBy("a", "a_g", "b_g").agg(*[F.sum(c).alias(c) for c in ("total", "known", "met")])
    return sums.filter("met > 0").drop("met")


def medoids(points: DataFrame, group: str, id_: str) -> DataFrame:
    """The point with the least summed distance to its group; ties go to the smaller id."""
    sums = distance_sums(points, group, id_, own=True).filter("known > 0").select(F.col("a_g").alias(group), "a", "total", (F.col("total") / F.col("known")).alias("mean_distance"))
    best = sums.groupBy(group).agg(F.min_by(F.struct("a", "mean_distance"), F.struct(F.round("total", 9), "a")).alias("m"))
    return best.select(group, F.col("m.a").alias("medoid"), F.col("m.mean_distance").alias("mean_distance"))


def silhouette(points: DataFrame, group: str, id_: str) -> DataFrame:
    """Per point (b - a) / max(a, b) from mean distances to its own and the nearest other cluster; alone is 0."""
    means = distance_sums(points, group, id_).withColumn("m", F.try_divide("total", "known"))
    own = F.max(F.when(F.col("a_g") == F.col("b_g"), F.col("m")))
    other = F.min(F.when(F.col("a_g") != F.col("b_g"), F.col("m")))
    out = means.groupBy("a", "a_g").agg(own.alias("own"), other.alias("other"))
    value = F.when(F.col("own").isNull() | F.col("other").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return out.select(F.col("a").alias(id_), F.col("a_g").alias(group), value.alias("silhouette"))


def rmsf(frames: DataFrame, atom: str) -> DataFrame:
    """Root mean square deviation of each atom from its mean place."""
    var = sum((F.var_pop(c) for c in "xyz"), F.lit(0.0))
    return frames.groupBy(atom).agg(F.sqrt(var).alias("rmsf"))


def box_margins(df: DataFrame, keys: Sequence[str], center: Sequence[float], size: Sequence[float]) -> DataFrame:
    """Least distance of the points of a key from each wall pair of a box; negative is outside."""
    out = []
    for c, mid, width in zip("xyz", center, size, strict=True):
        low, high = F.lit(mid - width / 2), F.lit(mid + width / 2)
        out.append(F.least(F.min(c) - low, high - F.max(c)).alias(f"margin_{c}"))
    return df.groupBy(*keys).agg(*out)


def best_altloc(atoms: DataFrame, keys: Sequence[str], alt: str, occupancy: str) -> DataFrame:
    preference = F.when(F.col(alt) == "", 0).when(F.col(alt) == "A", 1).otherwise(2)
    row = F.struct(*[c for c in atoms.columns if c not in keys])
    best = atoms.groupBy(*keys).agg(F.min_by(row, F.struct(-F.col(occupancy), preference, F.col(alt))).alias("b"))
    return best.select(*keys, "b.*")


def kabsch(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Proper rotation and shift that lay ``moving`` on ``fixed`` best (row vectors), and the RMSD left."""
    a, b = moving - moving.mean(axis=0), fixed - fixed.mean(axis=0)
    u, _, vt = np.linalg.svd(a.T @ b)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    rotation = u @ flip @ vt
    shift = fixed.mean(axis=0) - moving.mean(axis=0) @ rotation
    return rotation, shift, float(np.sqrt((((moving @ rotation + shift) - fixed) ** 2).sum(axis=1).mean()))


def align(pairs: DataFrame, key: str) -> DataFrame:
    """Per key the rigid transform from ``a_x, a_y, a_z`` onto ``b_x, ...`` and the RMSD after it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r, s, left = kabsch(group[["a_x", "a_y", "a_z"]].to_numpy(), group[["b_x", "b_y", "b_z"]].to_numpy())
        return pd.DataFrame({key: [group[key].iat[0]], "rotation": [r.ravel().tolist()], "shift": [s.tolist()], "rmsd": [left]})

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.groupBy(key).applyInPandas(run, f"{key} {kind}, rotation array<double>, shift array<double>, rmsd double")


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Ward's agglomeration to ``k`` clusters, labelled in the order of their first member.

    Clusters are kept as centres and sizes, in the order of their first members, each with the
    nearest of those after it; so memory grows with the points, and a merge looks at those
    alone whose nearest it was. Of equal merges the first pair wins.
    """
    n = len(x)
    centre, size, owner = np.array(x, float).T.copy(), np.ones(n), np.arange(n)
    first, dead = np.arange(n), np.zeros(n, bool)
    into = np.arange(n)  # of first members: the cluster that took them in

    def from_(i: int, lo: int) -> np.ndarray:
        out = np.zeros(len(size) - lo)
        for c in centre:
            d = c[lo:] - c[i]
            out += d * d
        out *= 2 * size[i] * size[lo:] / (size[i] + size[lo:])
        out[dead[lo:]] = np.inf
        return out

    near, far = np.full(n, -1), np.full(n, np.inf)

    def look(i: int) -> None:
        near[i], far[i] = -1, np.inf
        if i + 1 < len(size):
            d = from_(i, i + 1)
            j = int(d.argmin())
            if d[j] < np.inf:
                near[i], far[i] = i + 1 + j, d[j]

    for i in range(n):
        look(i)
    live = n
    while live > max(1, min(k, n)):
        i = int(far.argmin())
        j = int(near[i])
        total = size[i] + size[j]
        centre[:, i] = (centre[:, i] * size[i] + centre[:, j] * size[j]) / total
        size[i], into[first[j]] = total, first[i]
        dead[j], far[j] = True, np.inf
        live -= 1
        d = from_(i, 0)
        stale = np.flatnonzero(((near == i) | (near == j)) & ~dead)
        look(i)
        for h in stale.tolist():
            if h != i:
                look(h)
        fresh = np.flatnonzero(((d[:i] < far[:i]) | ((d[:i] == far[:i]) & (near[:i] > i))) & ~dead[:i])
        near[fresh], far[fresh] = i, d[fresh]
        if live < len(size) // 2 and len(size) > 64:  # leave out what was merged; the order stays
            kept = np.flatnonzero(~dead)
            place = np.full(len(size), -1)
            place[kept] = np.arange(len(kept))
            near = np.where(near[kept] >= 0, place[near[kept]], -1)
            centre, size, first, far, dead = np.ascontiguousarray(centre[:, kept]), size[kept], first[kept], far[kept], dead[kept]
    for i in range(n):  # a cluster's first member comes before the others
        owner[i] = owner[into[i]] if into[i] != i else i
    _, labels = np.unique(owner, return_inverse=True)
    return labels


def ward(points: DataFrame, key: str, id_: str, columns: Sequence[str], k: int) -> DataFrame:
    """Clusters of each key's points. A key is one task, whose memory grows with its points and whose time with their square."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(id_)
        labels = ward_labels(group[list(columns)].to_numpy(float), k)
        return pd.DataFrame({key: group[key].to_numpy(), id_: group[id_].to_numpy(), "cluster": labels})

    kinds = {c: points.schema[c].dataType.simpleString() for c in (key, id_)}
    spark = points.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = points.select(key, id_, *columns).repartition(tasks, key)  # keys are few and slow, so their small rows are not put together
    return dealt.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {id_} {kinds[id_]}, cluster long")


def maxmin_order(ids: Sequence, distance: dict, start, size: int) -> list:
    """Adds, again and again, the id farthest from those chosen; ties go to the smaller id."""
    chosen = [start]
    while len(chosen) < min(size, len(ids)):
        rest = [i for i in ids if i not in chosen]
        chosen.append(min(rest, key=lambda i: (-min(distance[i, c] for c in chosen), i)))
    return chosen


#: Centres that a choice on the driver looks at; more are refused.
CENTRES_ON_DRIVER = 100_000


def centres(points: DataFrame, group: str) -> list:
    """The mean point of each group, on the driver."""
    rows = points.groupBy(group).agg(*[F.avg(x).alias(x) for x in "xyz"]).limit(CENTRES_ON_DRIVER + 1).collect()
    if len(rows) > CENTRES_ON_DRIVER:
        raise ValueError(f"more than {CENTRES_ON_DRIVER} groups")
    return rows


#: Fixed value: the gas constant in kJ per mol and kelvin.
GAS_CONSTANT = 0.00831446261815324


def temperature(kinetic_energy: Column, freedoms: Column) -> Column:
    """Kelvin, from the kinetic energy in kJ per mol and the degrees of freedom."""
    return 2 * kinetic_energy / (freedoms * GAS_CONSTANT)


def diameters(points: DataFrame, group: str) -> DataFrame:
    """The largest distance between two points of each group, exactly.

    The extremes of thirteen directions give a lower bound. With the largest distance R from
    the group's centre, a point nearer to it than the bound less R is in no larger pair; only
    the others, near the hull, are paired.
    """
    centre = points.groupBy(group).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    rows = points.join(centre, group).select(group, *"xyz", F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("cx")) ** 2)).alias("away"))
    ways = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    place, ends = F.struct(*"xyz"), []
    for i, way in enumerate(ways):
        along = sum((F.col(n) * w for n, w in zip("xyz", way, strict=True)), F.lit(0.0))
        ends += [F.min_by(place, along).alias(f"lo{i}"), F.max_by(place, along).alias(f"hi{i}")]
    extremes = rows.groupBy(group).agg(F.max("away").alias("reach"), *ends)
    apart = [F.sqrt(sum(((F.col(f"hi{i}.{c}") - F.col(f"lo{i}.{c}")) ** 2 for c in "yz"), (F.col(f"hi{i}.x") - F.col(f"lo{i}.x")) ** 2)) for i in range(len(ways))]
    bounds = extremes.select(group, "reach", F.greatest(*apart).alias("least"))
    outer = rows.join(bounds, group).filter(F.col("away") >= F.col("least") - F.col("reach") - 1e-9)
    side = lambda p: outer.select(group, *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    return side("a_").join(side("b_"), group).groupBy(group).agg(F.sqrt(F.max(squared("a_", "b_"))).alias("diameter"))


def least_assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a matching of least total cost (square matrices), by shortest augmenting paths."""
    n = len(cost)
    row_of, u, v = np.full(n, -1), np.zeros(n), np.zeros(n)
    for start in range(n):
        far, came, open_, at, column = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool), start, -1
        reached = 0.0
        while True:  # grow a tree of tight edges until it reaches a free column
            new = reached + cost[at] - u[at] - v
            closer = open_ & (new < far)
            far[closer], came[closer] = new[closer], column
            column = int(np.where(open_, far, np.inf).argmin())
            reached = far[column]
            open_[column] = False
            if row_of[column] < 0:
                break
            at = row_of[column]
        done = ~open_
        done[column] = False
        u[row_of[done]] += reached - far[done]
        v[done] -= reached - far[done]
        u[start] += reached
        while column >= 0:
            before = came[column]
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    out = np.empty(n, int)
    out[row_of] = np.arange(n)
    return out


ASSIGNMENT = "rmsd double, farthest double, reason string"


def assignment_rmsd(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, rmsd, farthest, reason`` of two sets of atoms (``element, x, y, z``) whose order differs.

    Atoms of each element are matched such that their distances have the least sum. Where the
    sets do not have the same elements equally often, or one is missing, the reason says so
    and the figures are null. A key holds a molecule, so a group is small.
    """
    keys = list(keys)
    fields = [*keys, "element", "x", "y", "z"]

    def run(key, a, b):
        import pyarrow as pa

        sides = []
        for t in (a, b):
            names = np.array(t.column("element").to_pylist() if t.num_rows else [], object)
            xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1) if t.num_rows else np.zeros((0, 3))
            sides.append({e: xyz[names == e] for e in sorted(set(names.tolist()))})
        one, two = sides
        rmsd_, far, reason = None, None, None
        if not one or not two:
            reason = "missing"
        elif {e: len(p) for e, p in one.items()} != {e: len(p) for e, p in two.items()}:
            reason = "elements_differ"
        else:
            found = []
            for e, p in one.items():
                cost = np.sqrt(((p[:, None, :] - two[e][None, :, :]) ** 2).sum(axis=2))
                found.append(cost[np.arange(len(p)), least_assignment(cost)])
            d = np.concatenate(found)
            rmsd_, far = float(np.sqrt((d * d).mean())), float(d.max())
        values = [*[k.as_py() for k in key], rmsd_, far, reason]
        names = [*keys, "rmsd", "farthest", "reason"]
        return pa.table({n: pa.array([x], t) for n, x, t in zip(names, values, types, strict=True)})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    schema = StructType([*[first.schema[k] for k in keys], *StructType.fromDDL(ASSIGNMENT).fields])
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    return first.select(fields).groupBy(*keys).cogroup(second.select(fields).groupBy(*keys)).applyInArrow(run, schema)
