import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import TEXTS, documents, no_documents, rows
from pyspark.sql import functions as F

from lodestone.llm import common, exact_dedup, lattice, simhash
from lodestone.llm.common import connected_components


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected_exact(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(normal(t), []).append((-len(t or ""), i is None, i or 0, i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        out += [(i, keep[3], len(members), i == keep[3] and t == keep[4], hashlib.sha256(norm.encode()).hexdigest()) for *_, i, t in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("files_per_batch", [1, 256])
def test_exact_duplicates(spark, files_per_batch):
    found = exact_dedup.exact_duplicates(documents(spark), files_per_batch=files_per_batch)
    assert rows(found.select("doc_id", "keep_id", "group_size", "kept", "digest")) == expected_exact(TEXTS)


def test_bytes_decide_where_digests_collide(spark):
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1)
    found = exact_dedup.exact_duplicates(documents(spark), digest=weak)
    want = [r[:4] for r in expected_exact(TEXTS)]
    assert rows(found.select("doc_id", "keep_id", "group_size", "kept")) == sorted(want, key=repr)


def test_exact_nothing(spark):
    assert exact_dedup.exact_duplicates(no_documents(spark)).collect() == []


def test_exact_keep_first(spark):
    docs = documents(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len({normal(t) for _, t in TEXTS})
    assert sorted(normal(t) for _, t in got) == sorted({normal(t) for _, t in TEXTS})
    assert 2 in {i for i, _ in got} and 1 not in {i for i, _ in got}


def slow_fingerprint(text, shingle=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    for _, t in TEXTS:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    for _, t in TEXTS:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def components(nodes, linked):
    name = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return name


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius,few", [(2, simhash.FEW), (3, simhash.FEW), (3, 1)])
def test_ball_hashing_loses_no_link(spark, monkeypatch, radius, few):
    """With few = 1 every variant that several meet on is crowded, so full balls are emitted."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(radius)
    fps = {0}
    for _ in range(12):  # pairs at each distance, tight clusters and chains
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.choice([1, 1, 6, 25])):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
        for d in (1, 2, 3, 4):
            y = rng.getrandbits(64)
            fps |= {y, y ^ sum(1 << b for b in rng.sample(range(64), d)), y ^ ((1 << d) - 1)}
    fps = [signed(x) for x in fps]
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= radius]
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(frame, radius).collect()]
    named = {r["node"]: r["component"] for r in simhash.components(frame, radius).collect()}
    assert {x: named.get(x, x) for x in fps} == components(fps, near)
    assert components(fps, got) == components(fps, near)
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= radius for a, b in got)


def test_only_crowds_that_are_not_one_group_are_expanded(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    tight = [signed(base ^ (1 << a) ^ (1 << b)) for a in range(64) for b in range(a)][:400]
    frame = spark.createDataFrame([(x,) for x in [*tight, signed(base)]], "fp long")
    edges, groups, more = simhash._linked(frame, 3)
    assert more is None and {r["component"] for r in groups.collect()} == {min([*tight, signed(base)])} and groups.count() == 401
    assert edges.count() < 401 * 130 * 9


def test_near_duplicates(spark):
    rng = random.Random(2)
    long = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    texts = [*TEXTS, *((100 + k, " ".join([*long[:k], "changed", *long[k + 1 :]])) for k in range(0, 900, 60))]
    prints = {(i, t): slow_fingerprint(t) for i, t in texts}
    values = sorted(set(prints.values()))
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if bin(a ^ b).count("1") <= 3]
    group = components(values, near)
    lowest = {}
    for (i, t), f in prints.items():
        if i is not None:
            lowest[group[f]] = min(lowest.get(group[f], i), i)
    want = sorted(((i, format(prints[i, t], "016x"), lowest.get(group[prints[i, t]])) for i, t in texts), key=repr)
    found = simhash.near_duplicates(documents(spark, texts))
    assert rows(found.select("doc_id", simhash.fingerprint_hex(), "component_id")) == want
    assert simhash.near_duplicates(no_documents(spark)).collect() == []
    kept = simhash.keep_first(documents(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == {None, *lowest.values()}


def test_near_copies_are_removed_by_id_and_text(spark):
    """Rows 7 share an id, but only one of them is a near copy of something."""
    base = " ".join(f"w{k}" for k in range(400))
    texts = [(1, base), (7, base + " more"), (7, "something else altogether that has no copy"), (8, base + " more"), (9, base + " less"), (9, base + " and")]
    assert len({slow_fingerprint(t) for _, t in texts}) == 2
    for limit in (common.BROADCAST_ROWS, 0):
        common.BROADCAST_ROWS, before = limit, common.BROADCAST_ROWS
        kept = simhash.keep_first(documents(spark, texts)).collect()
        assert sorted((r["doc_id"], r["text"]) for r in kept) == [texts[0], texts[2]]
        common.BROADCAST_ROWS = before


def test_membership_never_holds_back_a_key(spark):
    keys = spark.range(0, 60_000, 3).select(F.xxhash64("id").alias("h"))
    flagged = common.with_membership(spark.range(60_000), F.xxhash64("id"), common.membership(keys, "h"), "in")
    counts = {(r["own"], r["in"]): r["count"] for r in flagged.groupBy((F.col("id") % 3 == 0).alias("own"), "in").count().collect()}
    assert counts[True, True] == 20_000 and (True, False) not in counts and counts.get((False, True), 0) < 4_000
    none = common.with_membership(spark.range(5), F.xxhash64("id"), common.membership(keys.limit(0), "h"), "in")
    assert not any(r["in"] for r in none.collect())


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(150)]
    edges += [(900, 899), (899, 901), (7, 7), (5, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    home = lattice.nearest_e8(x)
    doubled = np.rint(2 * home).astype(int)
    assert (np.abs(2 * home - doubled) < 1e-9).all()
    assert ((doubled % 2 == doubled[:, :1] % 2).all(axis=1)).all() and (home.sum(axis=1) % 2 == 0).all()
    own = ((x - home) ** 2).sum(axis=1)
    around = ((x[:, None] - home[:, None] - lattice._roots()[None]) ** 2).sum(axis=2)
    assert (own[:, None] <= around + 1e-9).all() and len(lattice._roots()) == 240


def expected_vectors(table, cosine=0.95):
    good = {k: np.array(v, float) for k, (_, v) in enumerate(table) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {k: v / np.abs(v).max() for k, v in good.items()}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    near = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    name = components(range(len(table)), near)
    low = {}
    for k, (i, _) in enumerate(table):
        low[name[k]] = min(low.get(name[k], i), i)
    links = [sum(k in e for e in near) for k in range(len(table))]
    return sorted(((i, links[k], low[name[k]], i == low[name[k]]) for k, (i, _) in enumerate(table)), key=repr)


def vectors():
    rng = np.random.default_rng(3)
    table = []
    for _ in range(20):
        base = rng.normal(size=64)
        for s in (0, 0.05, 0.1, 0.2, 0.25):
            table.append((len(table), (base + s * rng.normal(size=64)).astype(np.float32).tolist()))
    hot = rng.normal(size=64)
    table += [(1000 + k, (hot + 0.12 * rng.normal(size=64)).astype(np.float32).tolist()) for k in range(90)]
    table += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [1.0, None] * 32), (2004, [float("nan")] * 64), (2005, [float("inf")] * 64), (2006, table[0][1]), (2006, table[0][1]), (2007, [1.0, 2.0, 3.0]), (2008, [1.0, 2.0, 3.1]), (2009, [1e30] * 64), (2010, [-0.0, 1.0])]
    return table


@pytest.mark.parametrize("block", [16, 512])
def test_near_vectors(spark, block):
    table = vectors()
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("cid", F.lit(1)).withColumn("keys", F.lit("x"))
    got = rows(lattice.near_vectors(df, block=block))
    assert got == expected_vectors(table)


@pytest.mark.parametrize("width", [2, 3, 4, 8, 9, 12, 16, 64, 300, 2048])
@pytest.mark.parametrize("n", [100, 50_000, 20_000_000, 10**9])
def test_plans_keep_their_recall_at_every_size_and_width(n, width):
    """Pairs at cosine 0.95 exactly, the hardest, with the lattice that a table of n vectors gets."""
    tables, scale = lattice.plan(n, dim=width)
    a, b = lattice._pairs_at(0.95, 1000, width, 99)
    cells = lattice.Lattice(width, tables, lattice.PROBES, scale, lattice.SEED)
    ka, kb = cells.keys(a), cells.keys(b)
    met = (kb == ka[:, :, :1]).any(axis=2) | (ka == kb[:, :, :1]).any(axis=2)
    assert met.any(axis=1).mean() >= 0.95
    assert tables * (1 + lattice.PROBES) <= 500


@pytest.mark.parametrize("width", [1, 2, 5])
def test_narrow_vectors(spark, width):
    """Every pair that links, by comparing all; one cell holds so many that it is cut into blocks."""
    rng = np.random.default_rng(width)
    x = rng.standard_normal((240, width))
    x[:90] = x[0] + 0.05 * rng.standard_normal((90, width))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [0.0] * width)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    got = {r["vec_id"]: r for r in lattice.near_vectors(df, block=16).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * (near.sum() - 240)
    assert all(got[i]["n_links"] <= near[i].sum() - 1 for i in range(240)) and got[500]["n_links"] == 0
    if width == 1:
        assert [got[i]["component_id"] for i in range(240)] == [int(np.flatnonzero(near[i])[0]) for i in range(240)]


def test_groups_of_different_lengths_are_apart():
    """Two cells with equal names, one of vectors with two components and one with three."""
    keys = np.zeros((1, 2), "<i8").tobytes()
    rows = [(dim, 0, 5, cid, 1, True, np.ones(dim, "<f8").tobytes(), keys) for dim in (2, 3) for cid in (10 * dim, 10 * dim + 1)]
    names = ["dim", "table", "cell", "cid", "mult", "home", "vec", "keys"]
    batch = pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)})
    found = [r for out in lattice._compare(0.95, 2, "<f8")([batch]) for r in out.to_pylist()]
    assert {(r["cid"], r["leader"]) for r in found} == {(20, 20), (21, 20), (30, 30), (31, 30)}


def test_no_vectors(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
