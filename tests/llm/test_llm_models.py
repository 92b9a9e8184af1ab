"""Language identification, whitening and fill-in-the-middle."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitchlens.llm import language, middle, whitening

FOLDER = "/root/testdata/sf0.001"


# Fill-in-the-middle


def plain_middle(doc_id, text):
    """Output, form and numbers by string operations."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    told = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(told[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return text, "plain", len(units), None, None
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return f"<S>{suffix}<P>{prefix}<M>{mid}", "spm", len(units), len(prefix), len(mid)
    return f"<P>{prefix}<S>{suffix}<M>{mid}", "psm", len(units), len(prefix), len(mid)


ODD_TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "ä\n€\n𝄞𝄞\nz", "x <P> y\nz", "<S>", "a<M>", "a<P\nb>c<", "<\nP>\n<P",
    "\r\n\t\x0b  \x85\n", "line\n" * 50_000, "no break " * 200_000,
]


def test_middle_equals_string_operations(spark):
    rows = [(i * 31 + k, t) for i, t in enumerate(ODD_TEXTS) for k in range(12)]
    rows += [(None, "a\nb\nc"), (None, None), (5, "a\nb"), (5, "a\nb"), (-3, "q\nr\ns\n")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, output string, n int")
    arranged = middle.fill_in_middle(docs)
    got = middle.restored(arranged).collect()
    assert len(got) == len(rows)
    found = sorted(((str(r.doc_id), r.output, r.form, r.n, r.prefix_chars, r.middle_chars) for r in got), key=str)
    assert found == sorted(((str(i), *plain_middle(i, t)) for i, t in rows), key=str)
    texts = sorted((str(i), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), r.restored) for r in got) == texts
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digests = middle.restored(arranged, digest_only=True)
    assert "output" not in digests.columns and "restored" not in digests.columns
    assert sorted(r.restored_sha256 for r in digests.collect()) == sorted(r.restored_sha256 for r in got)


def test_middle_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert middle.restored(middle.fill_in_middle(docs), digest_only=True).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n<>PSMé𝄞", max_size=40), st.integers(-100, 10**12))
def test_pieces_round_trip(text, doc_id):
    rules = middle.Rules()
    n, form, output, sizes = rules.arrange(doc_id, text.encode())
    want = plain_middle(doc_id, text)
    assert (output.content().decode(), form, n, *(sizes or (None, None))) == want
    back = rules.rebuild(output.content(), form)
    assert back.content() == text.encode() and back.sha256() == hashlib.sha256(text.encode()).hexdigest()


def test_piece_table_keeps_its_buffers():
    table = middle.PieceTable(b"abcdef", (b"<P>", b"<S>"))
    cut = table.cut(2).cut(2).cut(6)
    assert [bytes(v) for v in cut.views()] == [b"ab", b"", b"cdef", b""]
    assert cut.buffers is table.buffers and table.pieces == (middle.Piece(middle.TEXT, 0, 6),)
    order = (2, 0, 3, 1)
    assert cut.permute(order).content() == b"cdefab" and cut.permute(order).restore(order).pieces == cut.pieces
    with pytest.raises(ValueError):
        table.cut(7)


# Whitening


def whole(vectors):
    return np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000


def check_whitening(spark, vectors, most=8):
    rows = [(i, [float(c) for c in v], "x", 1) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component int")
    got = whitening.whiten(frame).toPandas().sort_values(["component", "vec_id"])
    x = whole(vectors)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    rank = min(most, int((e > e[0] * 1e-12).sum()))
    assert sorted(set(got.component)) == list(range(1, rank + 1)) and len(got) == n * rank
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    for k in range(rank):
        part = got[got.component == k + 1]
        assert part.deviation.tolist() == deviation == [int(v) for v in part.deviation_exact]
        assert (part.n == n).all() and part.identity_error.max() < 1e-9
        assert part.explained.iloc[0] == pytest.approx(e[k] / e.sum(), rel=1e-9)
    return got, centred, e, u


def test_whitening_equals_an_eigensolver(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 12)) * np.linspace(2, 0.3, 12) + rng.standard_normal(12)
    got, centred, e, u = check_whitening(spark, vectors)
    for k in range(8):
        mine = got[got.component == k + 1].whitened.to_numpy()
        want = centred @ u[:, k] / np.sqrt(e[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9


def test_whitening_of_equal_variances_and_low_rank(spark):
    axes = np.concatenate([np.eye(5), -np.eye(5)]) / 4  # one variance, five times
    check_whitening(spark, axes)
    flat = np.zeros((6, 10))
    flat[:, 0], flat[:, 1] = np.arange(6), np.arange(6) ** 2
    check_whitening(spark, flat)
    same = spark.createDataFrame([(1, [0.5, 0.25])] * 4, "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.limit(1)).count() == whitening.whiten(same.limit(0)).count() == 0


def test_whitening_leaves_out_and_keeps(spark):
    good = [[0.5, 1.0], [0.25, -1.0], [-0.5, 0.125], [0.5, 1.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, [0.75, 0.5]), (2, [-0.5, 0.125])]
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [1.0, float("-inf")]]
    wide = [(100 + i, [float(i), float(i * i % 5), 1.0]) for i in range(7)]
    frame = spark.createDataFrame(rows + [(50 + i, v) for i, v in enumerate(bad)] + wide, "vec_id long, embedding array<double>")
    got = whitening.whiten(frame).toPandas()
    narrow = got[(got.vec_id < 50) | got.vec_id.isna()]
    assert len(narrow) == 6 * 2 and (narrow.n == 6).all()
    assert len(got) == 6 * 2 + 7 * 2 and (got[got.vec_id >= 100].n == 7).all()
    again = whitening.whiten(frame.repartition(5)).toPandas()
    key = lambda f: sorted(f[["vec_id", "component", "whitened"]].fillna(-1).round(9).values.tolist())
    assert key(got) == key(again)


def test_whitening_beyond_a_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [1.0, 3.0]), (3, [2.0, -1e9]), (4, [0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 8 and got[got.vec_id == 1].deviation.isna().all()
    small = spark.createDataFrame([(i, [1e7 * (i % 3), 1e6 * (i % 5)]) for i in range(40)], "vec_id long, embedding array<double>")
    got = whitening.whiten(small).toPandas()
    x = whole([[1e7 * (i % 3), 1e6 * (i % 5)] for i in range(40)]).astype(object)
    want = [sum((40 * a - s) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    one = got[got.component == 1].sort_values("vec_id")
    assert [int(v) for v in one.deviation_exact] == want


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions."""
    d = len(matrix)
    out, m = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = [sum(matrix[i][t] * m[t][i] for t in range(d)) for i in range(d)]
        out.append(-Fraction(sum(am), k))
    return [int(c) for c in reversed(out)]


@pytest.mark.parametrize("seed", range(4))
def test_characteristic_polynomial_is_exact(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(10 ** (2 + seed)), 10 ** (2 + seed), (9, 6 + seed)).astype(object)
    base[:, 1] = base[:, 0] * (seed % 2)  # singular, with zero columns in the Hessenberg steps
    matrix = (base.T @ base).tolist()
    got = whitening.characteristic_polynomial(spark, matrix)
    assert got == exact_polynomial(matrix)
    roots = whitening.largest_roots(got, 6)
    values = np.sort(np.linalg.eigvalsh(np.array(matrix, float)))[::-1]
    assert [r.low / 2**r.shift for r in roots] == pytest.approx(values[: len(roots)].tolist(), rel=1e-9)


def test_roots_with_multiplicity():
    polynomial = [1]
    for root in (9, 9, 9, 4, 1, 0, 0):
        polynomial = [a - root * b for a, b in zip([0, *polynomial], [*polynomial, 0])]
    roots = whitening.largest_roots(polynomial, 8)
    assert [r.times for r in roots] == [3, 1, 1]
    assert [(r.low + r.width) / 2**r.shift for r in roots] == [9, 4, 1]


def test_exact_gram_of_large_numbers():
    rng = np.random.default_rng(8)
    y = rng.integers(-(1 << 62), 1 << 62, (3000, 4))
    big = y.astype(object)
    assert (whitening.exact_gram(y) == big.T @ big).all()
    value = int((big.T @ big)[0, 0])
    assert sum(d << (32 * k) for k, d in enumerate(whitening.digits_of(-value))) == -value


# Language


def test_network_equals_loops():
    net = language.ByteNetwork.new(["a", "b", "c"], 4)
    net.bias += np.linspace(-0.2, 0.2, len(net.bias)).astype(np.float32)
    windows, sizes = language.windows_of("déjà vu ".encode() * 40)
    assert len(windows) == 2 and sizes.tolist() == [256, 144] and (windows[1][144:] == language.PAD).all()
    for row, got in zip(windows, net.probabilities(windows)):
        best = []
        for i, width in enumerate(language.WIDTHS):
            for f in range(i * language.FILTERS, (i + 1) * language.FILTERS):
                sums = []
                for at in range(language.WINDOW):
                    symbols = [row[at + k] if at + k < language.WINDOW else language.PAD for k in range(width)]
                    part = net.filters[: width * language.EMBEDDING, f].reshape(width, -1)
                    sums.append(sum(float(net.embedding[s] @ part[k]) for k, s in enumerate(symbols)))
                best.append(max(0.0, max(sums) + net.bias[f]))
        scores = np.array(best) @ net.weights + net.offset
        want = np.exp(scores - scores.max())
        assert got == pytest.approx(want / want.sum(), abs=1e-5)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    net = language.ByteNetwork.new(["a", "b", "c"], 4)
    for name in ("embedding", "filters", "bias", "weights", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows, answers = rng.integers(97, 110, (5, language.WINDOW)).astype(np.int16), np.array([0, 1, 2, 1, 0])
    _, slopes = language.gradients(net, windows, answers)
    for p, slope in zip(net.parameters(), slopes):
        for at in rng.permutation(np.argwhere(np.abs(slope) > 1e-4))[:4]:
            at = tuple(at)
            kept = p[at]
            p[at] = kept + 1e-6
            up, _ = language.gradients(net, windows, answers)
            p[at] = kept - 1e-6
            down, _ = language.gradients(net, windows, answers)
            p[at] = kept
            assert (up - down) / 2e-6 == pytest.approx(slope[at], rel=0.02, abs=1e-5)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = docs.withColumn("lang", F.when(~language.is_held_out(F.col("doc_id")), F.col("lang")))
    net = language.fit(seen)
    assert net.languages == ["de", "en", "es", "fr"]
    got = language.identify(docs, net).toPandas().set_index("doc_id")
    want = docs.toPandas().set_index("doc_id")
    assert len(got) == len(want)
    for i, row in got.iterrows():
        assert row.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        text = want.text[i]
        if not text or not any(c.isalpha() for c in text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
    held = got[got.held_out & (got.lang_pred != "und")]
    assert len(held) > 150 and (held.lang_pred == want.lang[held.index]).mean() >= 0.97
    assert got.score.between(0, 1).all()
    again = language.identify(docs.repartition(7), language.fit(seen.repartition(5))).toPandas().set_index("doc_id")
    assert (again.lang_pred[got.index] == got.lang_pred).all()


def test_language_of_odd_rows(spark):
    train = [(i, ("der die das und " if i % 2 else "the and of that ") * 9, "de" if i % 2 else "en") for i in range(400)]
    train += [(1000, None, "fr"), (1001, "123 --", "fr"), (None, "le la les et", "fr"), (1002, "quoi", None)]
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in train], "doc_id long, text string, lang string, source string, score double")
    net = language.fit(docs)
    assert net.languages == ["de", "en"]
    texts = [None, "", " \n", "123 456 ½ !", "the", "und", "the and of that " * 40_000, "ß", "语", None]
    odd = spark.createDataFrame([(i if i < 9 else None, t) for i, t in enumerate(texts)] + [(4, "the")], "doc_id long, text string")
    got = language.identify(odd, net).collect()
    assert len(got) == 11
    told = {r.doc_id: r.lang_pred for r in got}
    assert [told[i] for i in range(4)] == ["und"] * 4 and told[None] == "und"
    assert told[4] == "en" and told[6] == "en" and {told[5], told[7], told[8]} <= {"de", "en"}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(odd.limit(0), net).count() == 0


def test_long_texts_are_scored_whole():
    net = language.ByteNetwork.new(["a", "b"], 9)
    text = np.random.default_rng(1).integers(32, 127, 100_003).astype(np.uint8).tobytes()
    short = b"some words"
    together = language._texts_scored(net, [short, text, short])
    windows, sizes = language.windows_of(text)
    mean = (net.probabilities(windows) * sizes[:, None]).sum(axis=0) / sizes.sum()
    assert together[1] == (net.languages[int(mean.argmax())], pytest.approx(float(mean.max()), abs=1e-6))
    assert together[0] == together[2] and math.isclose(together[0][1], language._texts_scored(net, [short])[0][1], abs_tol=1e-6)


def test_windows_for_the_fit_are_spread():
    text = b"".join(bytes([65 + i % 26]) * language.WINDOW for i in range(100))
    batch = pa.RecordBatch.from_arrays([pa.array([text.decode(), "ab"]), pa.array(["en", "de"])], ["text", "lang"])
    (out,) = language._chosen(iter([batch]))
    assert out.num_rows == language.FIT_WINDOWS + 1
    places = [b[0] - 65 for b in out["bytes"].to_pylist()[:-1]]
    assert len(set(places)) > 4 and max(places) > 8
