import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import near_dedup, setsketch
from lodestrata.llm.components import components


def words(text, k):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k=4, num=80, den=100):
    """(n_shingles, smallest id reachable) for each row of (id, text), by comparing all pairs."""
    sets = [words(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(top(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def test_query_against_all_pairs(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    got = near_dedup.op1_minhash_near_dedup(spark, tables)
    assert got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    out = got.collect()
    assert sorted(((r[0], r[1], r[2]) for r in out), key=repr) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one Two"), (5, "ONE two"), (6, "one two"), (7, base), (8, base.upper()), (9, base + " x"), (9, base), (9, "another text of some words"), (None, base), (None, None), (10, "É b c d e"), (11, "é b c d e"), (12, base + " y" * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("row", "id", "n", "regs", "cell", "mark")})
    got = near_dedup.near_duplicates(df, k=4).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)
    firsts = [(r["id"], r["component_id"]) for r in got if r["first"] and r["n_shingles"]]
    assert all(a == b for a, b in firsts) and len(firsts) == len({(r["component_id"], r["n_shingles"] == 2) for r in got if r["n_shingles"]}) or len(firsts) >= 5


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 0 and near_dedup.deduplicated(df).columns == ["doc_id", "text"]


def test_chain_of_near_copies_in_one_hot_group(spark):
    """Copies that differ from their neighbours alone are still one group; a group is cut into blocks."""
    w = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(500):
        w = list(w)
        w[(i * 7) % 120] = f"n{i}"
        rows.append((i, " ".join(w)))
    assert len({x[2] for x in brute(rows)}) < 10
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("step", [1, 6])
def test_hot_groups_of_many_blocks_and_parts(spark, monkeypatch, step):
    """Blocks of 8: chains of copies that share their buckets with others they are not linked to, over several rounds."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = []
    for part in range(3):
        w = [f"w{i}" for i in range(100)] + [f"p{part}x{i}" for i in range(14)]
        for i in range(60):
            w = list(w)
            w[(i * 7 * step) % 100] = f"n{part}x{i}"
            rows.append((1000 * part + i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)


def test_rows_stay_in_proportion_to_a_bucket(spark, monkeypatch):
    """Many texts that share buckets and are hardly linked: neither the exact round nor those before it copy them by the
    square of the group; rounds with pivots join hard buckets alone."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    common = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(common + [f"n{i}x{j}" for j in range(16)])) for i in range(200)] + [(200 + i, " ".join(common + [f"n{i}x{j}" for j in range(13)])) for i in range(100)]
    sent, staged, stage, met = {}, [], near_dedup.stage, near_dedup._met

    def watched(held, jobs, num, den, turn, exact):
        sent[turn] = jobs.select(F.explode("kept").alias("x")).groupBy("x.key").agg(F.count("*").alias("members"), F.sum(F.when(F.col("x.wide"), F.col("x.blocks")).otherwise(1)).alias("copies")).collect()
        return met(held, jobs, num, den, turn, exact)

    def counted(df, tag):
        out = stage(df, tag)
        staged.append((tag, out))
        return out

    monkeypatch.setattr(near_dedup, "_met", watched)
    monkeypatch.setattr(near_dedup, "stage", counted)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)
    last = sent[max(sent)]
    assert len(sent) > 2 and max(r["members"] for r in last) > 80
    assert all(r["copies"] <= (1 + near_dedup.WIDE) * r["members"] for r in last)
    hard = F.expr(f"blocks > 1 and outside * blocks > {near_dedup.WIDE} * members")
    unsettled = [x.where(hard).agg(F.sum("members")).first()[0] for tag, x in staged if tag == "unsettled"]
    assert [x.count() for tag, x in staged if tag == "here"] == unsettled[:-1]


def test_deduplicated_keeps_one_whole_row(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "a"), (1, text, "b"), (2, text + " z", "c"), (3, None, "d"), (4, None, "e")]
    out = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, pos string")).collect()
    assert sorted(r["pos"] for r in out)[-2:] == ["d", "e"] and len(out) == 3


def test_shingles_are_those_of_the_rule():
    texts = ["", None, "a", "a b c d", "A b C d e", "a\x0bb\x1cc d", "a b c d e a b c d e", " x  y ", "w " * 50]
    for t, s in zip(texts, setsketch.shingle_sets(pa.array(texts), 4), strict=True):
        assert len(s) == len(words(t, 4))
    long = ["x" * 3_000_000 + " a b c d e f", "w " * 1_500_000 + "v", " ".join(map(str, range(400_000)))]
    assert [len(s) for s in setsketch.shingle_sets(pa.array(long), 4)] == [len(words(t, 4)) for t in long]
    same = setsketch.shingle_sets(pa.array(["k", "A b c d e", "zz a B c d e"]).slice(1), 4)
    assert set(same[0]) < set(same[1])


@pytest.mark.parametrize("true", [0.5, 0.8, 0.95])
def test_registers_estimate_similarity(true):
    rng = np.random.default_rng(3)
    a, b = [], []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        rest = int(400 * (1 - true) / true / 2)
        a.append(np.concatenate((both, rng.integers(0, 1 << 63, rest, dtype=np.uint64))))
        b.append(np.concatenate((both, rng.integers(0, 1 << 63, rest, dtype=np.uint64))))
    x, y = setsketch.sketch(a), setsketch.sketch(b)
    more, less = (x > y).sum(1), (x < y).sum(1)
    n = np.array([len(s) for s in a])
    found = setsketch.likely_jaccard(more, less, x.shape[1] - more - less, n, n)
    assert abs(found.mean() - true) < 0.02 and np.abs(found - true).max() < 0.17


def test_sketches_merge():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 40))
    one, two, both = setsketch.sketch([a, b, np.concatenate((a, b))])
    assert (np.maximum(one, two) == both).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (102, 102), (103, 100)] + [(200, x) for x in range(201, 260)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100, **dict.fromkeys(range(200, 260), 200)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_cells_hold_few_rows_as_objects():
    n, rng = 6000, np.random.default_rng(5)
    sets = [np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64)) for _ in range(n // 2)]
    regs = setsketch.sketch(sets)
    at = np.repeat(np.arange(n // 2), 2)  # each cell holds a set twice; cells of 2 rows lie across the parts of a batch
    kept = pa.array([[{"key": int(c), "band": b, "blocks": 1, "wide": False} for b in range(32)] for c in at])
    columns = [pa.array(at), pa.array([0] * n), pa.array([False] * n), pa.array(range(n)), pa.array(range(n)), pa.array([0] * n), kept]
    columns += [pa.array([regs[c].tobytes() for c in at]), pa.array([sets[c].tobytes() for c in at])]
    whole = pa.record_batch(columns, ["key", "block", "wide", "row", "label", "band", "kept", "regs", "shingles"])
    tracemalloc.start()
    try:
        links = [(a, b) for out in near_dedup._confirm(80, 100, True)(iter([whole.slice(0, 1), whole.slice(1)])) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
    assert sorted(sorted(x) for x in links) == [[2 * i, 2 * i + 1] for i in range(n // 2)]
