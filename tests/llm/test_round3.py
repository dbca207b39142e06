"""Hard negatives, SimHash groups and whitening against brute force."""

import random
import re
from collections import defaultdict
from fractions import Fraction
from math import floor, isfinite

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orrery.llm import common, neardup, negatives, queries, simhash, whitening

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v and all(c is not None and isfinite(c) for c in v)


def vectors(n=700, d=6, seed=3):
    """Vectors near a few centres, with repeated vectors and rows, ties, other lengths, nulls and non-finite entries."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    rows = []
    for i in range(n):
        v = centres[i % 5] + 0.3 * rng.normal(size=d)
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(0, 4))))
    rows += [(n + i, rows[3][1], i % 3) for i in range(200)]  # one vector, many ids
    rows += [rows[100], rows[100], rows[200]]  # repeated rows
    rows += [(n + 300, None, 1), (n + 301, [], 1), (n + 302, [NAN] * d, 1), (n + 303, [INF] + [0.0] * (d - 1), 2)]
    rows += [(n + 304, [None] + [0.0] * (d - 1), 2), (n + 305, [-0.0] * d, 2), (n + 306, [0.5, 1.0], 1), (None, rows[5][1], 1), (n + 307, rows[5][1], None)]
    return rows


# 11 --------------------------------------------------------------------------------------


def brute_negatives(rows):
    kept = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(floor(256 * c) for c in v)) for i, v, label in rows if i is not None and label is not None and usable(v)}
    out = []
    for a, mine, x in kept:
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, label) for i, label, y in kept if i != a and len(y) == len(x)]
        scored.sort()
        for p_score, p, _ in [s for s in scored if s[2] == mine][:5]:
            fits = [s for s in scored if s[2] != mine and 30 * -p_score <= 100 * -s[0] <= 90 * -p_score]
            out += [(a, p, k, i, -p_score, -s) for k, (s, i, _) in enumerate(fits[:10], 1)]
    return sorted(out)


NEGATIVE = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def taken(df, names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_hard_negatives_agree_with_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"score": F.lit("x"), "anchor": F.lit(3), "x": F.lit(0)}).repartition(3)
    out = negatives.query(df)
    assert dict(out.dtypes)["rank"] == "int" and out.columns == NEGATIVE
    want = brute_negatives(rows)
    assert taken(out, NEGATIVE) == want and len(want) > 100


def test_hard_negatives_in_small_pieces_and_blocks(spark):
    rows = vectors(n=400, seed=8)
    df = whitening.whole_numbers(spark.createDataFrame(rows, VECTORS))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = df.select("vec_id", label.alias("label"), F.col("__x").alias("x"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    assert taken(negatives.hard_negatives(df, numbers=600, block=2), NEGATIVE) == brute_negatives(rows)


def test_hard_negatives_agree_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    got = con.execute(negatives.SQL)
    names = [c[0] for c in got.description]
    assert taken(queries.queries()["op11_hard_negatives"](spark, FOLDER), names) == sorted(got.fetchall())


def test_hard_negatives_of_empty_tables_and_without_anchors(spark):
    assert negatives.query(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.query(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0, 2.0], 2)], VECTORS)).count() == 0
    assert negatives.query(spark.createDataFrame([(100, [1.0, 2.0], 1)], VECTORS)).count() == 0


def test_rows_that_share_an_id_are_anchors_of_their_own(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.25], 2), (3, [0.25, 0.5], 2)]
    assert taken(negatives.query(spark.createDataFrame(rows, VECTORS)), NEGATIVE) == brute_negatives(rows)


def test_ball_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 300
    x = np.floor(centres[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 8)) * 10).astype(np.int64)
    label, ids = rng.integers(0, 3, len(x)), rng.permutation(len(x))
    tree = negatives.BallTree(x, label, ids)
    q, own = x[:50], ids[:50]
    for same in (True, False):
        top = np.full(50, 10**9)
        low, high = (np.full(50, negatives.LEAST), np.full(50, negatives.MOST)) if same else (top // 100_000, top // 2000)
        scores, found, computed = negatives.search(tree, q, label[:50], own, low, high, same, 5)
        for i in range(50):
            s = x @ q[i]
            fits = (label == label[i]) & (ids != own[i]) if same else (label != label[i]) & (s >= low[i]) & (s <= high[i])
            assert sorted(zip(-s[fits], ids[fits]))[:5] == [(-a, b) for a, b in zip(scores[i], found[i]) if a > negatives.LEAST]
        assert computed < 0.25 * 50 * len(x)  # labels alone would leave a third and two thirds


def test_products_stay_exact_beyond_doubles():
    q, x = np.array([[2**30 + 1, 3]]), np.array([[2**30 + 1, 5], [-7, 2**20]])
    assert negatives.products(q, x).tolist() == [[(2**30 + 1) ** 2 + 15, -7 * (2**30 + 1) + 3 * 2**20]]
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2**40]]), np.array([[2**40]]))


# 12 --------------------------------------------------------------------------------------

TEXTS = "doc_id long, text string"


def brute_fingerprint(text):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    points = [(i, brute_fingerprint(t)) for i, t in rows]
    near = defaultdict(set)
    distinct = {p for i, p in points if i is not None}
    for p in distinct:
        near[p] = {q for q in distinct if (p ^ q).bit_count() <= 2}
    ids = defaultdict(list)
    for i, p in points:
        if i is not None:
            ids[p].append(i)
    component = {}
    for p in distinct:
        if p not in component:
            seen, todo = {p}, [p]
            while todo:
                more = near[todo.pop()] - seen
                seen |= more
                todo += more
            component |= dict.fromkeys(seen, min(i for q in seen for i in ids[q]))
    return sorted(((i, f"{p:016x}", None if i is None else component[p]) for i, p in points), key=repr)


def texts(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdEFéö") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(12)]
    rows = []
    for i in range(200):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 1, 2, 4, 30])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(300, None), (301, ""), (302, " \r\n"), (303, "one"), (304, "One two"), (305, "one two three"), (306, "ONE two three"), (307, "x" * 300_000)]
    rows += [(308, "a b c a b c a b c a b"), (309, " ".join(words) * 900), rows[4], rows[4], (5, "another text"), (None, rows[7][1]), (None, None)]
    return rows


def test_simhash_agrees_with_all_pairs(spark):
    rows = texts()
    df = spark.createDataFrame(rows, TEXTS).withColumns({"node": F.lit("x"), "anchor": F.lit(1), "label": F.lit(2)}).repartition(3)
    got = sorted(map(tuple, simhash.query(df).collect()), key=repr)
    assert got == brute_groups(rows)
    assert len({c for _, _, c in got}) < len({p for _, p, _ in got})  # some link besides equal ones


def test_fingerprint_of_any_cut(monkeypatch):
    whole = [simhash.fingerprint(t) for _, t in texts()[:30]]
    for piece in (1, 7, 50):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(t) for _, t in texts()[:30]] == whole


def test_anchors_cover_and_are_as_many_as_stated(spark):
    rng = random.Random(2)
    points = [rng.getrandbits(64) - 2**63 for _ in range(200)] + [0, -1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(p,) for p in points], "node long")
    for reach, most in ((1, 3), (2, 65), (3, 715)):
        for node, held in df.select("node", simhash.anchors(F.col("node"), reach)).collect():
            assert 1 <= len(set(held)) == len(held) <= most
            for a in held:
                assert ((a ^ node) & (2**64 - 1)).bit_count() <= reach
                syndrome = 0
                for b in range(63):
                    syndrome ^= (b + 1) * (a >> b & 1)
                assert syndrome == 0


def test_links_among_crowded_fingerprints(spark):
    """A dense ball of fingerprints, both reaches: the same components as all pairs give."""
    rng = random.Random(4)
    points = {0}
    for centre in (0, 0x123456789ABCDEF0, 2**64 - 1):
        for _ in range(250):
            p = centre
            for _ in range(rng.randint(0, 3)):
                p ^= 1 << rng.randrange(64)
            points.add(p)
    points |= {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in points], "node long")

    def groups(pairs):
        above = {p: p for p in points}

        def top(x):
            while above[x] != x:
                x = above[x]
            return x

        for a, b in pairs:
            above[top(a)] = top(b)
        out = defaultdict(set)
        for p in points:
            out[top(p)].add(p)
        return sorted(map(sorted, out.values()))

    want = groups((a, b) for a in points for b in points if a < b and (a ^ b).bit_count() <= 2)
    for reach in (None, 3):
        found = [(a % 2**64, b % 2**64) for a, b in simhash.links(df, 2, reach).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in found) and groups(found) == want
    assert len(found) < 40 * 700 * len(points)


def test_simhash_of_an_empty_table(spark):
    out = simhash.query(spark.createDataFrame([], TEXTS))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


# 13 --------------------------------------------------------------------------------------


def brute_whitening(rows, d):
    kept = [(i, [floor(256 * c) for c in v]) for i, v, *_ in rows if usable(v) and len(v) == d]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ v[:, :4] / np.sqrt(e[:4])
        out.setdefault(i, []).append((deviation, w))
    return n, e / e.sum(), out


def whitening_agrees(got, rows, d):
    n, share, want = brute_whitening(rows, d)
    assert len(got) == 4 * sum(map(len, want.values()))
    signs = {}
    for r in got:
        assert r["n"] == n and abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        devs = [x[0] for x in want[r["vec_id"]]]
        assert int(r["deviation"]) in devs
        w = want[r["vec_id"]][devs.index(int(r["deviation"]))][1][r["component"] - 1]
        if abs(w) > 1e-6:
            signs.setdefault(r["component"], set()).add(np.sign(w * r["whitened"]))
        assert abs(abs(w) - abs(r["whitened"])) < 1e-8
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_agrees_with_the_covariance(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"n": F.lit("x"), "component": F.lit(0), "__v": F.lit(0)}).repartition(7)
    out = whitening.query(df)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    whitening_agrees(out.collect(), rows, 6)


def test_whitening_over_a_deep_tree_with_long_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=5) * 1e7 + 1e9], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(20)
    whitening_agrees(whitening.whiten(df, fan=2).collect(), rows, 5)


def test_whitening_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    whitening_agrees(queries.queries()["op13_whitening"](spark, FOLDER).collect(), rows, 64)


def test_whitening_without_variance_or_rows(spark):
    assert whitening.query(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.query(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], VECTORS)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(9)]  # one direction only
    out = whitening.query(spark.createDataFrame(flat, VECTORS)).collect()
    assert {r["component"] for r in out} == {1} and len(out) == 9 and abs(out[0]["explained"] - 1) < 1e-12


# copies and labels -------------------------------------------------------------------------


def test_copies_are_made_in_pieces_by_several_tasks(spark, monkeypatch):
    from orrery.llm import common

    monkeypatch.setattr(common, "COPIES", 100)
    df = spark.createDataFrame([("a", 1), ("b", 100), ("c", 101), ("d", 5000)], "k string, n long")
    out = common.numbered_copies(df, "n", "i", 5000, "k").withColumn("task", F.spark_partition_id())
    rows = out.groupBy("k").agg(F.count("i").alias("c"), F.count_distinct("i").alias("d"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_distinct("task").alias("tasks")).collect()
    assert {(r["k"], r["c"], r["d"], r["lo"], r["hi"]) for r in rows} == {("a", 1, 1, 1, 1), ("b", 100, 100, 1, 100), ("c", 101, 101, 1, 101), ("d", 5000, 5000, 1, 5000)}
    assert {r["k"]: r["tasks"] for r in rows}["d"] > 1


def test_mix_and_shards_of_many_equal_rows_in_pieces(spark, monkeypatch):
    from orrery.llm import common, mixing, sharding

    schema = "doc_id long, text string, source string"
    df = spark.range(20_000).selectExpr("cast(1 as long) doc_id", "'the same few words' text", "'a' source").unionByName(spark.createDataFrame([(2, "another one", "b"), (3, None, "c")], schema))
    whole = sorted(map(tuple, mixing.query(df).collect()), key=repr)
    shards = sharding.external_shuffle(df, 7, bucket_rows=500).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("hi")).collect()
    monkeypatch.setattr(common, "COPIES", 64)
    assert sorted(map(tuple, mixing.query(df).collect()), key=repr) == whole and len(whole) == 20_002
    again = sharding.external_shuffle(df, 7, bucket_rows=500).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("hi")).collect()
    assert sorted(again) == sorted(shards) and all(r["n"] == r["d"] == r["hi"] + 1 for r in again)
    taken = sum(r[4] for r in whole)
    assert abs(mixing.mix(df).select(common.n_words(F.col("text")).alias("w")).agg(F.sum("w")).first()[0] - taken) <= 4 * 3


def test_dirty_labels_are_learned_by_frequency(spark, monkeypatch):
    from orrery.llm import language

    monkeypatch.setattr(language, "LANGS", 2)
    rows = [(i, "the quick brown fox jumps over it", "en") for i in range(40)] + [(100 + i, "der schnelle braune fuchs springt", "de") for i in range(40)]
    rows += [(1000 + i, "zzz", f"dirt{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.labelled_sample(df)) == {"en", "de"}
    assert {r["lang_pred"] for r in language.query(spark, df.filter("lang = 'en'")).collect()} == {"en"}


# --- near-duplicates: groups of near copies, and lists that outgrow a broadcast ------------------------------


def near_copies(n=300):
    base = [f"w{i}" for i in range(60)]
    return [(i, " ".join([*base[: i % 50], f"x{i}", *base[i % 50 + 1 :]])) for i in range(n)]


def test_near_copies_are_chained_with_few_links(spark, monkeypatch):
    """A class meets the hub of its buckets once, not once a bucket."""
    seen, plain = [], neardup.components

    def counted(edges):
        edges = edges.distinct()
        seen.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(neardup, "components", counted)
    rows = near_copies()
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}
    assert seen[0] <= 3 * len(rows)


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_long_lists_of_keys_are_not_broadcast(spark, how):
    rows = spark.range(5000).select(F.when(F.col("id") % 100 != 3, F.col("id")).alias("k"), F.lit("x").alias("t"))
    listed = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    one, two = (common.join_listed(rows, listed, "k", how, 1 << 10, bound) for bound in (None, 0))
    assert sorted(one.collect(), key=str) == sorted(two.collect(), key=str)
    held = neardup.drop_near_duplicates(spark.createDataFrame(near_copies(40), "doc_id long, text string"))
    common_bytes, common.LISTED_BYTES = common.LISTED_BYTES, 0
    try:
        again = neardup.drop_near_duplicates(spark.createDataFrame(near_copies(40), "doc_id long, text string"))
        assert held.collect() == again.collect()
    finally:
        common.LISTED_BYTES = common_bytes
