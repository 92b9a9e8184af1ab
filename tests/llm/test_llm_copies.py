"""SimHash, vectors, repeated strings and components against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pitchlens.llm import graph, repeats, simhash, vectors

DOCS = "doc_id long, text string, fp string, component_id long, data string, k1 int"


def docs(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 7, "y", 1) for i, t in zip(ids, texts)], DOCS)


def roots(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(500, 500), (601, 600)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.root for r in graph.components(df).collect()}
    expected = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 400)} | {601: 600}
    assert {k: v for k, v in got.items() if k != v} == expected
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > n)


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(400)])
    texts = [None, "", " \t", "One two", "one TWO", "Äpfel ÄPFEL x y z"]
    for _ in range(60):
        base = rng.choice(words, rng.integers(3, 300))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 4)):
            near = base.copy()
            near[rng.integers(len(near))] = "changed"
            texts.append("\n".join(near))
    texts += ["Word " * 40_000, "word " * 40_001]
    ids = [None, None, *range(2, len(texts))]
    got = simhash.near_duplicates(docs(spark, texts, ids)).collect()
    prints = [plain_fingerprint(t) for t in texts]
    label = roots(
        len(texts),
        [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4],
    )
    smallest = {c: min([i for i, x in zip(ids, label) if x == c and i is not None], default=None) for c in label}
    expected = sorted((i is not None, i or 0, p, smallest[c]) for i, p, c in zip(ids, prints, label))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in got) == expected


def test_links_reach_the_whole_radius(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, np.uint64)
    values = [int(v) for v in base]
    for v in list(values):
        for bits in range(1, 7):
            values.append(v ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    values = sorted(set(values))
    near = {(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4}
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    for pretended in (1, 200_000):  # few and many leading bits
        found = simhash.links(df, pretended).collect()
        where = {v: i for i, v in enumerate(values)}
        pairs = [(where[r.a % 2**64], where[r.b % 2**64]) for r in found]
        assert roots(len(values), pairs) == roots(len(values), near)


def test_one_of_each_group(spark):
    texts = ["a b c d e", "a b c d e", None, "", "f g h i j", "a b c d e", "f g h i j"]
    kept = simhash.one_of_each_group(docs(spark, texts, [5, 3, None, 9, None, 3, None]))
    assert kept.columns == DOCS.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [
        ("3", "a b c d e"), ("9", ""), ("None", "f g h i j"),
    ]
    assert simhash.one_of_each_group(docs(spark, [])).count() == 0
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, node string, leaf int"


def brute_links(rows, least=0.93):
    usable = [
        label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
        and any(v)
        for _, v, label in rows
    ]
    links = []
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            if usable[i] and usable[j] and rows[j][2] == label and len(v) == len(rows[j][1]):
                a, b = np.array(v, float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("leaf_rows, block", [(256, 1024), (16, 8)])
def test_vectors_against_brute_force(spark, monkeypatch, leaf_rows, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        v = rng.standard_normal(24).astype(np.float32)
        rows.append((len(rows), v.tolist(), int(i % 3)))
        for _ in range(rng.integers(0, 3)):
            rows.append((len(rows), (v + rng.standard_normal(24) * 0.12).astype(np.float32).tolist(), int(i % 3)))
    one = rng.standard_normal(24)
    rows += [(1000 + i, (one + rng.standard_normal(24) * 0.02).astype(np.float32).tolist(), 1) for i in range(60)]
    rows += [(2000, rows[0][1], 0), (2001, rows[0][1], 1), (2002, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(2003, None, 0), (2004, [0.0] * 24, 0), (2005, [None] + [1.0] * 23, 0), (2006, [float("nan")] * 24, 0)]
    rows += [(2007, [float("inf")] + [1.0] * 23, 0), (2008, [], 0), (2009, rows[0][1][:5], 0), (2003, None, 0)]
    df = spark.createDataFrame([(*r, "x", 4) for r in rows], VECTORS)
    got = vectors.near_vectors(df, leaf_rows=leaf_rows).collect()
    links = brute_links(rows)
    label = roots(len(rows), links)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    found = sum(r.n_links for r in got) / 2
    assert len(got) == len(rows)
    assert 0.95 * len(links) <= found <= len(links)
    if leaf_rows == 256:
        smallest = {c: min(r[0] for r, x in zip(rows, label) if x == c and r[0] is not None) for c in label}
        expected = sorted(
            (str(r[0]), int(degree[i]), smallest[label[i]], None if r[0] is None else r[0] == smallest[label[i]])
            for i, r in enumerate(rows)
        )
        assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == expected


def noisy_group(n, dims, noise, seed=8):
    """Unit vectors, the first third of them a dense group."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dims))
    centre = rng.standard_normal(dims)
    v[: n // 3] = centre / np.linalg.norm(centre) + v[: n // 3] * noise / np.sqrt(dims)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("noise", [0.24, 0.27, 0.32])
def test_dense_groups_share_leaves(noise):
    v = noisy_group(60_000, 64, noise)
    forest = vectors.Forest(v[::3], 8, 8, 0.07, np.sqrt(2 - 2 * 0.93) / 2, 5)
    rows, leaves = forest.leaves(v[:20_000])
    homes = {}
    for r, leaf in zip(rows.tolist(), leaves.tolist()):
        homes.setdefault(r, set()).add(leaf)
    pairs = np.random.default_rng(9).integers(0, 20_000, (20_000, 2))
    near = [(a, b) for a, b in pairs.tolist() if a != b and v[a] @ v[b] >= 0.93]
    assert len(near) > 1000
    assert sum(bool(homes[a] & homes[b]) for a, b in near) >= 0.99 * len(near)


def test_dense_group_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    v = noisy_group(3000, 32, 0.27)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, leaf_rows=16).collect()}
    true = (v @ v.T >= 0.93).sum(1) - 1
    found = np.array([got[i] for i in range(3000)])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum() > 0


def test_vectors_of_an_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_forest_finds_nearly_all_pairs_of_near_copies(spark):
    """Groups of two to hundreds of near copies among the given vectors, which have no links themselves."""
    rng = np.random.default_rng(3)
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    rows = [(int(i), np.asarray(v, float).tolist(), int(k)) for i, v, k in zip(given.vec_id, given.embedding, given.label)]
    for _, vec, label in rows[:: 40]:
        vec, size = np.array(vec), int(rng.choice([1, 2, 5, 20, 200], p=[0.4, 0.3, 0.2, 0.08, 0.02]))
        noise = rng.standard_normal((size, len(vec))) * np.linalg.norm(vec) / np.sqrt(len(vec)) * rng.uniform(0.05, 0.3)
        rows += [(len(rows) + 10**6 + i, (vec + n).tolist(), label) for i, n in enumerate(noise)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_vectors(df).agg(F.sum("n_links"), F.count_if(~F.col("kept"))).first()
    rows = df.toPandas()
    true, kept = 0, 0
    for _, part in rows.groupby("label"):
        v = np.stack(part.embedding.to_numpy()).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        near = v @ v.T >= 0.93
        true += int(near.sum()) - len(v)
    assert true > 1000 and 0.98 * true <= got[0] <= true


def cut_out(texts, least):
    data = [(t or "").encode() for t in texts]
    count = {}
    for b in data:
        for p in range(len(b) - least + 1):
            count[b[p : p + least]] = count.get(b[p : p + least], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - least + 1):
            if count[b[p : p + least]] > 1:
                gone[p : p + least] = True
        edges = int((gone[:-1] & ~np.concatenate([[False], gone[:-2] if len(b) else gone[:0]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "WINDOWS_AT_ONCE", 500 if seed else 1 << 17)
    rng = np.random.default_rng(seed)
    alphabet = list("abcdefgh äß")
    def noise(n):
        return "".join(rng.choice(alphabet, n))
    shared = [noise(n) for n in (150, 199, 200, 201, 260, 900)]
    texts = [None, "", "short", "z" * 700, "z" * 650, "ab" * 400, noise(190)]
    for _ in range(40):
        parts = [noise(rng.integers(0, 300))]
        for _ in range(rng.integers(0, 3)):
            s = shared[rng.integers(len(shared))]
            cut = rng.integers(0, 30)
            parts += [s[cut:] if rng.random() < 0.5 else s, noise(rng.integers(0, 90))]
        texts.append("".join(parts))
    texts += [texts[10], texts[10], texts[11] + "!", noise(3000)]
    ids = [None, None, *range(2, len(texts) - 1), 3]
    got = repeats.without_repeats(docs(spark, texts, ids)).collect()
    expected = [(str(i), *row) for i, row in zip(ids, cut_out(texts, 200))]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(expected)
    assert repeats.without_repeats(docs(spark, [])).count() == 0


def test_texts_are_returned_only_where_they_are_asked_for(spark):
    df = docs(spark, ["a" * 300, "b" * 250 + "x", "y" + "b" * 250, None, "c" * 300])
    short = repeats.without_repeats(df, with_text=False)
    assert "kept" not in short.columns and " kept#" not in short._jdf.queryExecution().toString()
    whole = repeats.without_repeats(df)
    assert sorted(short.collect(), key=str) == sorted(whole.drop("kept").collect(), key=str)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in whole.collect())


def test_runs_end_with_their_text():
    ends, n = np.array([0, 10, 10, 14, 20]), np.array([3, 0, 1, 2])
    own, first, last = repeats._runs(ends, n, np.array([6, 0, 2, 0, 0, 3]), np.array([10, 2, 4, 4, 1, 5]))
    assert list(zip(own, first, last)) == [(0, 0, 4), (0, 6, 10), (2, 10, 14), (3, 14, 15), (3, 17, 19)]
    assert not len(repeats._runs(np.array([0]), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))[0])


def test_python_steps_of_the_links_do_not_share_a_task(spark, monkeypatch):
    plans = []
    usual = simhash.components

    def components(links, label):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return usual(links, label)

    monkeypatch.setattr(simhash, "components", components)
    text = " ".join(f"word{i}" for i in range(400))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, [text, text + " end", "other"])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    assert len(plans) == 1 and "InArrow" not in plans[0]
