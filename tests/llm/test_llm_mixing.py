"""Mixing and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitchlens.llm import mixing

FOLDER = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water filling by bisection, as a check of the resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    low, high = 0.0, 2 * sum(sizes.values()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(most * sizes[s], mid * w[s]) for s in names) < share * sum(sizes.values()):
            low = mid
        else:
            high = mid
    return {s: min(most * sizes[s], high * w[s]) for s in names}


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, p int, unit string")


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(6000):
        source = [None, "ß", "a", "b", "Z", "c"][min(5, int(rng.exponential(1.3)))]
        rows.append((i, "w " * int(rng.integers(0, 60)), source))
    rows += [(None, "w w", "a"), (None, "w w", "a"), (7, rows[7][1], rows[7][2]), (9000, None, "b"), (9001, "", None)]
    rows += [(9002, "w " * 20_000, "a")]
    got = mixing.mix(documents(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    assert sorted(got["size"]) == sorted(len((t or "").split()) for _, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted = plain_targets(sizes)
    for name, part in got.groupby(got.source.fillna("<null>")):
        source = None if name == "<null>" else name
        assert part.target.iloc[0] == pytest.approx(wanted[source], rel=1e-9)
        assert (part.source_size == sizes[source]).all()
        assert abs(part.taken.sum() - wanted[source]) <= part["size"].max() / 2 + 1
    again = mixing.mix(documents(spark, rows[::-1]).repartition(3)).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert got[key].value_counts(dropna=False).to_dict().items() == again[key].value_counts(dropna=False).to_dict().items() or (
        sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    )


def test_chances_are_kept_on_average(spark):
    docs = documents(spark, [(i, "w " * (1 + i % 7), "a") for i in range(200)] + [(900 + i, "w " * 50, "b") for i in range(40)])
    runs = [mixing.mix(docs, seed=s).filter("source = 'b'").toPandas() for s in range(6)]
    ratio = runs[0].target.iloc[0] / runs[0].source_size.iloc[0]
    mean = np.mean([r.copies.mean() for r in runs])
    assert abs(mean - ratio) < 0.05
    assert len({tuple(r.sort_values("doc_id").copies) for r in runs}) > 1


def test_mix_of_empty_and_wordless_tables(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    got = mixing.mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = docs.selectExpr("*", "1 as fp", "'x' as base", "2 as copies").limit(150)
    odd = spark.createDataFrame(
        [(None, None, None, None, None, 1, "x", 2), (None, "", "en", "s", 0, 1, "x", 2), (3, "a@b.org", None, None, 7, 1, "x", 2)] * 2,
        extra.schema,
    )
    docs = extra.unionByName(odd)
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, FOLDER)
        assert function(spark, docs.limit(0), FOLDER).count() == 0
        if name != "mixing":
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
            docs = corpus_pipeline.stage(out, f"test-{name}")
        else:
            assert out.filter("_copies < 1").count() == 0 and out.count() > 0
            assert out.columns[: len(docs.columns)] == docs.columns and "text" in out.columns


def test_pipeline_runs(spark):
    first = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert 0 < len(first) <= 200 and first.doc_id.is_unique
    again = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert first.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()


def test_mixed_documents_are_whole_rows(spark):
    rows = [(i % 40 if i % 9 else None, "w " * (i % 13) if i % 11 else None, "ab"[i % 2] if i % 7 else None) for i in range(400)]
    rows += [(5, "same words here", "a")] * 30 + [(6, "same words here", "b")]
    docs = documents(spark, rows).withColumnRenamed("p", "copies")
    got = mixing.mixed_documents(docs)
    assert got.columns == ["doc_id", "text", "source", "copies", "unit", "size", "source_size", "target", "_copies", "taken"]
    want = mixing.mix(docs.withColumn("row", F.xxhash64("doc_id", "text", "source", F.col("doc_id").isNull())), id_col="row")
    told = {(r.source, r.size): (r.n, r.taken) for r in want.filter("copies > 0").groupBy("source", "size").agg(
        F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()}
    found = got.toPandas()
    assert (found._copies >= 1).all() and (found._copies <= 2).all() and (found.taken == found._copies * found["size"]).all()
    assert {k: v[0] for k, v in told.items() if k[1] == 0} == {
        (s, 0): n for s, n in got.filter("size = 0").groupBy("source").count().collect()
    }
    originals = {}
    for r in rows:
        originals[r] = originals.get(r, 0) + 1
    for key, part in found.groupby(["doc_id", "text", "source"], dropna=False):
        key = tuple(None if v is None or v != v else v for v in key)
        assert len(part) <= originals[(None if key[0] is None else int(key[0]), key[1], key[2])]
    for source, part in found.groupby(found.source.fillna("<null>")):
        total = part.taken.sum()
        assert abs(total - part.target.iloc[0]) <= part["size"].max() / 2 + 1
    again = mixing.mixed_documents(docs.repartition(5)).toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, found.values.tolist()))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
