"""Archives, page texts, personal data, decontamination, toxicity and scoring."""

import datetime
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitchlens.llm import htmltext, leaks, privacy, queries, scoring, toxicity, warc
from pitchlens.staging import new_path

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, payload string, record_type int, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


def test_archives_round_trip(spark):
    long = "<p>" + "ä" * 700 + "</p>"
    rows = [
        (1, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (5, None, long), (3, "http://a/3", "short"),
        (4, "http://a/4", "short"), (6, "http://a/6", None), (7, "http://a/7", ""), (None, "http://a/8", long),
        (9, "http://a/9", "x" * 999), (10, "http://a/9", "x" * 999), (11, "u", "x" * 1000), (12, "u", "x" * 1000),
        (13, "http://big", "y" * 3_000_000), (13, "http://big", "y" * 3_000_000),
    ]
    folder = new_path(spark, "warc")
    index = warc.write_archives(pages(spark, rows), folder)
    got = warc.read_records(index, folder).collect()
    refers = {1: 5, 2: 5, 11: 12, None: 5}
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        kind = "revisit" if page in refers else "response"
        expected.append((str(page), len(data), hashlib.sha1(data).hexdigest(), kind, refers.get(page)))
    assert sorted(
        (str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got
    ) == sorted(expected, key=str) or sorted(
        ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str
    ) == sorted(expected, key=str)
    texts = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert texts[5].decode() == long and texts[6] == b"" and len(texts[13]) == 3_000_000
    chosen = index.filter(F.col("url") == "http://a/4")
    assert [bytes(r.payload) for r in warc.read_records(chosen, folder).collect()] == [b"short"]
    empty = warc.write_archives(pages(spark, []), new_path(spark, "warc"))
    assert warc.read_records(empty, folder).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header>Site</header><nav><ul><li><a>Home</a></li></ul></nav><div class="ad">Buy</div><!-- c -->
<article><h1>A &amp; B</h1><p><b>One&nbsp;
 two<br>three<p>x &lt; y</p><div class="comments"><p>first!</p></div><form>q</form></article>
<aside>side</aside><div id="cookie-notice">ok?</div><footer>&copy; 2020</footer></body></html>"""
PLAIN = "<html><body><div>Site</div><div>{0}</div><p>Own {0} words here.</p><div>Imprint</div></body>"


def test_page_texts(spark):
    rows = [
        (1, "http://h/a", PAGE), (2, "http://h/b", None), (3, "http://h/c", ""), (4, None, "<p>alone"),
        (5, "http://i/x/1", PLAIN.format("one")), (6, "http://i/x/2", PLAIN.format("two")),
        (7, "http://j/1", PLAIN.format("copy")), (8, "http://j/2", PLAIN.format("copy")), (None, "http://k", "<br>z"),
        (9, "http://l", "<article>" + "<p>word </p>" * 3000 + "</article>"), (9, "http://l", "<article><p>word</article>"),
    ]
    got = htmltext.extract(pages(spark, rows).coalesce(1)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {}
    for r in got:
        texts.setdefault(r.page_id, []).append(r.text)
    assert texts[1] == ["A & B\n\nOne two three\n\nx < y"]
    assert texts[2] == texts[3] == [""] and texts[4] == ["alone"] and texts[None] == ["z"]
    assert texts[5] == ["one\n\nOwn one words here."] and texts[6] == ["two\n\nOwn two words here."]
    assert texts[7] == ["Site\n\ncopy\n\nOwn copy words here.\n\nImprint"]  # copies are no frame
    assert sorted(texts[9]) == sorted(["\n\n".join(["word"] * 3000), "word"])
    assert htmltext.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("html", [
    "<html class='no-js menu'><body class='single right-sidebar'><p>Text",
    "<html><body class='nav'><p>Text",
    "<article class='post comments-open share'><p>Text</p></article><p>other",
    "<main id='menu'><p>Text</p><div class='ad'>Buy</div></main>",
    "<div class='widget'><div id='header'><div class='ad'>Buy</div><article><p>Text</p></article></div></div>",
    "<div class='right-sidebar-layout'>Text</div><div class='sidebar'>side</div>",
    "<div class='ad'>Buy</div><article>Text</article><div class='related'>more</div>",
    "<nav><article>teaser</article></nav><p>Text</p>",
])
def test_names_of_frames_do_not_hide_articles(html):
    assert htmltext.main_text(htmltext.page_lines(html), None) == "Text"


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    left, right = htmltext.common_lines(a, b)
    assert len(left) == table[-1, -1] and left == sorted(set(left)) and right == sorted(set(right))
    assert [a[i] for i in left] == [b[j] for j in right]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_base_spans_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    bits = ["a@b.com", "_x@c.org", "@", ".", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111",
            "4111-1111-1111-1111", "+49 (30) 1234-5678", "+1", " ", "  ", "-", "ü", "𝒳", "word", "+", "%", "12", "7"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(600)]
    texts += [None, "", "1" * 20_000, "1 " * 20_000, "a" * 20_000 + "@", "a.b@" * 3000, "1." * 9000, "+" * 500, "+1-" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", privacy._written(F.coalesce(privacy.base_spans(F.col("text")), F.array().cast(privacy.SPAN)))).collect()
    for i, spans in got:
        assert spans == plain_spans(texts[i] or ""), texts[i][:80]


def test_disclosing_terms_are_treated(spark):
    secret = [f"Zarathustra wrote to zara@x.org about {w} weather" for w in ("nice", "bad", "odd", "mild")]
    other = [f"people talk about {w} weather daily number {i}" for i, w in enumerate(["nice", "bad", "odd", "mild"] * 10)]
    rows = [(i, t, "x", 3, "c") for i, t in enumerate(secret + other + [None, "", "zarathustra spoke"])]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long, clean string")
    got = {r.doc.doc_id: r for r in privacy.sanitise(df).collect()}
    # "Zarathustra" occurs once more without the address, the next two words never do.
    assert got[0].clean == "[TERM] [REMOVED] [REMOVED] [EMAIL] about nice weather"
    assert "zara" not in got[1].clean.lower() and got[10].clean == rows[10][1]
    assert got[len(secret + other)].clean is None and got[len(secret + other) + 2].clean == "zarathustra spoke"
    assert privacy.sanitise(df).count() == len(rows) and privacy.sanitise(df.limit(0)).count() == 0
    spans = {privacy.KINDS[s["rank"]] for s in got[2].spans}
    assert spans == {"email", "term"}


def plain_disclosure(texts, generalise=1.0, remove=0.5, z=1.28):
    """Terms to treat by text: every entity with every term, by loops."""
    entities, terms, own = {}, {}, set()
    for text in set(texts):
        spans = [x.split(":") for x in plain_spans(text).split(",") if x]
        entities[text] = set()
        for kind, start, stop in spans:
            value = text[int(start):int(stop)].lower()
            entities[text].add(value if kind in ("email", "ip") else (kind, re.sub("[^0-9]", "", value)))
            if kind == "email":
                account = "account " + value.split("@")[0]
                entities[text].add(account)
                own |= {(account, w) for w in re.findall("[a-z]+", value.split("@")[0])}
        bare = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", " ", text)
        terms[text] = set(re.findall("[a-z]+", bare.lower()))
    out = {text: {} for text in terms}
    for e in set().union(*entities.values()):
        having = [text for text in terms if e in entities[text]]
        for t in set().union(*(terms[text] for text in having)):
            met = [text for text in having if t in terms[text]]
            more = (e, t) in own
            p = (sum(texts.count(x) for x in met) + more) / (sum(t in terms[x] for x in texts) + more)
            n = (len(met) + more) / p
            low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
            if -np.log2(low) <= generalise:
                mark = "[REMOVED]" if -np.log2(low) <= remove else "[TERM]"
                for text in met:
                    out[text][t] = min(mark, out[text].get(t, mark))
    return out


@pytest.mark.parametrize("part_terms", [1024, 2])
def test_disclosing_terms_equal_brute_force(spark, monkeypatch, part_terms):
    monkeypatch.setattr(privacy, "PART_TERMS", part_terms)
    rng = np.random.default_rng(8)
    names = ["anna", "bo.li", "cem.7", "dora-k", "info"]
    texts = []
    for i in range(120):
        words = list(rng.choice([f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"], 4)) + ["the"]
        if i % 2:
            who = int(rng.integers(5))
            words += [f"{names[who]}@{rng.choice(['x.org', 'y.net'])}", *rng.choice([f"k{'abcde'[who]}", "li", "dora"], 2)]
        if i % 7 == 0:
            words += ["10.0.0.%d" % rng.integers(3), "+49 30 123456%d" % rng.integers(3), "call"]
        if i % 40 == 0:
            words += [f"lonely@z{i}.org", f"{'abcd'[i // 40]}only", "lonely"]
        rng.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:30] + texts[:1] * 40
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df = df.withColumns({"k1": F.xxhash64("text"), "k2": F.char_length("text")})
    flagged = privacy.disclosing_terms(df)
    got = df.dropDuplicates(["text"]).join(flagged, ["k1", "k2"], "left").collect()
    expected = plain_disclosure(texts)
    assert {r.text: r.flagged or {} for r in got} == expected
    marks = [m for found in expected.values() for m in found.values()]
    assert {"[TERM]", "[REMOVED]"} == set(marks)


def test_words_of_an_only_address_are_treated(spark):
    rows = [(1, "Dear Quillon, write to quillon.9@x.org today"), (2, "write today dear all"), (3, "dear you")]
    rows += [(i, f"write to you today, dear {'abcdefgh'[i - 4]}") for i in range(4, 12)]
    got = {r.doc.doc_id: r.clean for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "Dear [TERM], write to [EMAIL] today" and all(got[i] == t for i, t in rows[1:])


def test_decontamination_finds_edited_copies(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "el", "ir", "os", "um", "ep", "ak")])
    items = [" ".join(rng.choice(words, n)) for n in (15, 30, 60, 200)] + [None, "", "two words"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, score int")
    rows, expected = [], set()
    for i, text in enumerate(items[:4]):
        for kind in range(4):
            parts = np.array(text.split(), object)
            if kind:  # every eighth word changed, one left out, one put in
                parts[kind::8] = "edited"
                parts = np.insert(np.delete(parts, 5), 9, "more")
            noise = [" ".join(rng.choice(words, 150)) for _ in range(2)]
            rows.append((len(rows), f"{noise[0]} {' '.join(parts).title()}. {noise[1]}", i, "x"))
            expected.add((len(rows) - 1, i))
    rows += [(len(rows) + k, " ".join(rng.choice(words, 400)), 0, "x") for k in range(30)]
    rows += [(None, items[1], 0, "x"), (900, None, 0, "x"), (901, "", 0, "x"), (0, rows[0][1], 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id long, score string")
    got = leaks.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected | {(None, 1)}
    assert sum(r.doc_id == 0 for r in got) == 2
    exact = [r for r in got if r.doc_id == 4]
    assert exact[0].score == 1 and exact[0].last_word - exact[0].first_word == 29
    kept = leaks.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows[16:46]} | {900, 901}
    assert leaks.leaks(df.limit(0), bench).count() == leaks.leaks(df, bench.limit(0)).count() == 0


def test_every_fourth_word_changed(spark):
    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(5000)])
    items = [rng.choice(words, n).tolist() for n in range(15, 60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows, expected = [], set()
    for i, item in enumerate(items):
        copy = [f"new{k}" if k % 4 == i // 4 % 4 else w for k, w in enumerate(item)]  # the only copy
        text = rng.choice(words, 80).tolist() + copy + rng.choice(words, 80).tolist()
        if leaks.align(np.array([hash(w) for w in item]), np.array([hash(w) for w in text]))[0] >= 0.4 * len(item):
            expected.add((i, i))
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(expected) > 30 and {(r.doc_id, r.item_id) for r in leaks.leaks(df, bench).collect()} == expected
    kept = {r.doc_id for r in leaks.without_leaks(df, bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in expected}


@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=10))
def test_alignment_equals_the_full_table(item, passage):
    best = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, x in enumerate(item):
        for j, y in enumerate(passage):
            best[i + 1, j + 1] = max(0, best[i, j] + (1 if x == y else -1), best[i, j + 1] - 1, best[i + 1, j] - 1)
    score, end = leaks.align(np.array(item), np.array(passage, dtype=int))
    assert score == best.max() and best[:, end].max() == score


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    told = toxicity.score(docs, model).drop("toxic").join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    wrong = told[(told.p_toxic >= 0.5) & (told.toxic == 0)]
    found = told[(told.p_toxic >= 0.5) & (told.toxic == 1)]
    assert len(wrong) <= 0.005 * (told.toxic == 0).sum() and len(found) >= 0.85 * (told.toxic == 1).sum()
    again = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    assert np.array_equal(model.weights, again.weights)


def test_toxicity_of_odd_rows(spark):
    rows = [(i, "you fool " * (i % 3) + f"calm words {i}", 1) for i in range(60)]
    rows += [(None, "fool", 1), (61, None, 1), (62, "", 1), (1, rows[1][1], 1), (63, "fool " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    labels = spark.createDataFrame(
        [(i, i % 3, 0) for i in range(60)] + [(None, 1, 0), (1, None, 0), (999, 1, 0)], "doc_id long, toxic int, text int"
    )
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model)
    assert got.count() == len(rows) and got.filter("severity is null").count() == 0
    assert toxicity.clean_documents(df, model).columns == df.columns
    assert toxicity.clean_documents(df, model).filter("doc_id in (61, 62)").count() == 2
    nothing = toxicity.fit(df, labels.limit(0))
    assert toxicity.clean_documents(df, nothing).count() == len(rows)
    assert toxicity.score(df.limit(0), model).count() == 0


def test_ordinal_fit_recovers_an_order():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 2))
    grade = np.digitize(x @ [2.0, -1.0] + rng.logistic(size=4000), [-1.0, 0.5, 2.0])
    rows, cols = np.repeat(np.arange(4000), 2), np.tile([0, 1], 4000)
    weights, cuts = toxicity.fit_ordinal(rows, cols, x.ravel(), grade, 2, 4, ridge=0)
    assert np.allclose(weights, [2, -1], atol=0.25) and np.allclose(cuts, [-1, 0.5, 2], atol=0.25)


def test_windows_of_long_items(spark):
    assert [leaks.window_starts(n) for n in (0, 1, 64, 65, 130)] == [[0], [0], [0], [0, 1], [0, 32, 64, 66]]
    words = [f"w{i}" for i in range(300)]
    bench = spark.createDataFrame([(n, " ".join(words[:n])) for n in (64, 65, 300)], "item_id long, text string")
    # Any 27 words of a window are enough, wherever they are cut, whatever the length of the item.
    pieces = [(i, "x y z " + " ".join(words[i : i + 27]) + " z y x") for i in range(0, 270, 9)]
    pieces.append((1000, " ".join(words[:20])))
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(pieces, "doc_id long, text string"), bench).collect()}
    assert {d for d, i in got if i == 300} == set(range(0, 270, 9))
    for item in (64, 65):
        assert {d for d, i in got if i == item} == {i for i in range(0, 270, 9) if i + 27 <= item + 1}


def test_item_of_very_many_different_words():
    rng = np.random.default_rng(1)
    rows = [(1, " ".join(f"v{i}" for i in range(2_200_000)))]
    block = leaks.make_block(rows, 3)
    seeds, part_of, offsets = leaks.all_seeds(block)
    at = int(rng.integers(1_000_000, 2_000_000))
    found = leaks._finder(block, seeds, part_of, offsets, 0.4)
    assert [f[0] for f in found(np.arange(at, at + 64))] == [1]
    assert list(found(rng.integers(0, 2_200_000, 500))) == []


def test_scoring_beats_counts_and_knows_order(spark):
    rng = np.random.default_rng(7)
    start = ["the", "a", "one"]
    def sentence():
        return f"{rng.choice(start)} {rng.choice(['red', 'blue'])} {rng.choice(['dog', 'cat', 'bird'])} runs ."
    texts = [" ".join(sentence() for _ in range(60)) for _ in range(200)]
    odd = [None, "", "  ", "the " * 20_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts + odd)] + [(None, texts[0], 5)],
                               "doc_id long, text string, pll int")
    lexicon, net = scoring.train(df, rate=0.1)
    got = {r.doc_id: r for r in scoring.score(df, lexicon, net).collect()}
    assert got[200].n_tokens == got[201].n_tokens == 0 and got[200].pll == 0 and got[200].mean_pll is None
    assert got[203].n_tokens == 20_000 and got[None].pll == pytest.approx(got[0].pll)
    words = texts[0].split()
    known = scoring.Words(pa.array([None, texts[0], " "]))
    token = known.token
    assert known.names.take(pa.array(token)).to_pylist() == words and known.size.tolist() == [0, len(words), 0]
    inputs, classes = lexicon.places(known.hashes(), known.endings())
    number = Counter(w for t in [*texts, *odd, texts[0]] for w in (t or "").lower().split())
    inside = np.log([number[w] / lexicon.mass[c] for w, c in zip(words, classes[token])])
    assert lexicon.mass[classes[token[0]]] == number[words[0]]
    counts = np.log([number[w] / sum(number.values()) for w in words])
    assert got[0].pll > 0.7 * counts.sum()
    shuffled = texts[0].split()
    rng.shuffle(shuffled)
    mixed = scoring.score(spark.createDataFrame([(0, " ".join(shuffled))], "doc_id long, text string"), lexicon, net)
    assert mixed.first().pll < got[0].pll
    # Brute force: every token on its own, from its own window.
    pad, total = [lexicon.sizes.inputs - 1] * 2, 0.0
    line = pad + inputs[token].tolist() + pad
    for i, t in enumerate(token):
        side = np.array([[line[i], line[i + 1], line[i + 3], line[i + 4]]])
        total += net.forward(side)[0, classes[t]] + inside[i]
    assert got[0].pll == pytest.approx(total, rel=1e-4)
    assert scoring.score(df.limit(0), *scoring.train(df.limit(0))).count() == 0
    # Words that the corpus does not have, in documents of a table of their own.
    other = spark.createDataFrame([(1, "xyzzy"), (2, "red")], "doc_id long, text string")
    other = {r.doc_id: r.pll for r in scoring.score(other, lexicon, net).collect()}
    assert np.isfinite(other[1]) and other[1] < other[2]


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SHARD_CHARS", 200_000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(docs.limit(5))
    told = []
    for parts in (2, 7):
        dealt = scoring.deal(docs.repartition(parts))
        shards = dealt.rows.select("shard").distinct().count()
        assert shards > 2
        names = scoring._names(spark, 300).collect()
        assert sorted(r.shard for r in names) == list(range(300)) and len({r.name for r in names}) == 300
        rows = scoring.score(dealt, *scoring.train(dealt)).collect()
        told.append(sorted((r.doc_id, r.n_tokens, r.pll) for r in rows))
    assert len(told[0]) == docs.count() and told[0] == told[1]
    # Better than the frequencies of words, which need no sides.
    words = Counter(w for r in docs.collect() for w in (r.text or "").lower().split())
    total = sum(words.values())
    plain = sum(n * np.log(n / total) for n in words.values())
    assert sum(pll for _, _, pll in told[0]) > plain


def test_copies_of_a_text_get_the_same_score_to_the_last_bit(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(150, 400, 40)]
    rows = [(100 * i + k, t) for i, t in enumerate(texts) for k in range(30)] + [(9001, None), (9002, "")]
    dealt = scoring.deal(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_tokens, r.pll) for r in scoring.score(dealt, *scoring.train(dealt)).collect()}
    assert len(got) == len(rows) and got[9001] == got[9002] == (0, 0.0)
    for i, text in enumerate(texts):
        assert len({got[100 * i + k] for k in range(30)}) == 1 and got[100 * i][0] == len(text.split())


def test_every_row_is_scored_also_if_it_repeats(spark):
    class Numbered(scoring.Network):
        """Takes off one more for every row that it is asked for, so rows show whether they were scored."""

        asked = 0

        def chosen(self, sides, wanted):
            got = super().chosen(sides, wanted) - 1000 * (self.asked + np.arange(len(sides)))
            self.asked += len(sides)
            return got

    rows = [(7, "one two")] * 4 + [(i, "one two") for i in range(3)] + [(8, "three"), (None, None)]
    dealt = scoring.deal(spark.createDataFrame(rows, "doc_id long, text string"))
    lexicon, net = scoring.train(dealt)
    told = scoring.score(dealt, lexicon, Numbered(lexicon).load(net.flat())).collect()
    assert len(told) == len(rows) and sum(r.n_tokens for r in told) == 15
    assert len({round(r.pll) for r in told}) == 9
    assert len({r.pll for r in scoring.score(dealt, lexicon, net).filter("n_tokens = 2").collect()}) == 1


def test_a_row_is_predicted_alike_wherever_it_stands(spark):
    lexicon, net = scoring.train(spark.createDataFrame([("a b c d e " * 40,)], "text string"))
    sides = np.random.default_rng(2).integers(0, lexicon.sizes.inputs, (999, 2 * scoring.SIDE))
    whole = net.forward(sides)
    wanted = np.arange(999) % lexicon.sizes.classes
    one = net.chosen(sides, wanted)
    assert one.tolist() == whole[np.arange(999), wanted].tolist()
    for start, n in ((0, 1), (1, 998), (5, 17), (500, 3), (935, 64)):
        some = slice(start, start + n)
        assert (net.forward(sides[some]) == whole[some]).all()
        assert net.chosen(sides[some], wanted[some]).tolist() == one[some].tolist()


def test_queries_read_whole_tables(spark):
    assert list(queries.queries()) == sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    n_docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op3_scoring", "op6_privacy", "op9_toxicity", "op10_repeats"):
        assert queries.queries()[name](spark, FOLDER).count() == n_docs


def test_sql_agrees(spark):
    import duckdb

    for name, sql in queries.oracle_sql().items():
        con = duckdb.connect()
        for t in ("pages", "embeddings", "documents"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        got = queries.queries()[name](spark, FOLDER)
        expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected)), name


def test_sample_of_repeated_ids_is_bounded(spark):
    rows = [(1, f"you fool number {i}") for i in range(300)] + [(2, "calm words")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    staged = []
    usual = toxicity.stage
    try:
        toxicity.stage = lambda df, label: staged.append((label, usual(df, label))) or staged[-1][1]
        toxicity.fit(docs, labels, rows=40)
    finally:
        toxicity.stage = usual
    assert dict(staged)["toxic-sample"].count() == 40


KEPT_OUT = [
    "<div class='comments'><article class='comment'><p>reader says</p></article></div>",
    "<div class='related'><article><h3>Other</h3></article></div>",
    "<article class='comment'><p>reader says</p></article>",
    *(f"<div class='{c}'><p>frame</p></div>" for c in (
        "comment-list", "comments-area", "ad-slot", "share-buttons", "cookieconsent", "main-nav", "site-footer", "cookie-bar")),
]


@pytest.mark.parametrize("extra", KEPT_OUT)
def test_frames_in_the_main_element_are_left_out(extra):
    page = f"<body class='right-sidebar'><main><p>Text</p>{extra}</main></body>"
    assert htmltext.main_text(htmltext.page_lines(page), None) == "Text"
    page = f"<article class='post comments-open'><p>Text</p>{extra}<p>More</p></article>"
    assert htmltext.main_text(htmltext.page_lines(page), None) == "Text\n\nMore"


def test_containers_of_the_article_are_no_frame():
    for around in ("sidebar", "left-sidebar", "with-sidebar", "header", "menu"):
        page = f"<div class='{around}'><article><p>Text, rather long</p></article></div><div class='sidebar'><article>x</article></div>"
        assert htmltext.main_text(htmltext.page_lines(page), None) == "Text, rather long", around
    assert htmltext.main_text(htmltext.page_lines("<article><p>Area <math><mi>a</mi></math> end</p></article>"), None) == "Area a end"
    assert htmltext.main_text(htmltext.page_lines("<div class='no-sidebar'><p>Text</p></div>"), None) == "Text"


def test_a_long_frame_goes_and_copies_are_passed_over(spark):
    menu = "".join(f"<div>Menu {i}</div>" for i in range(10))
    rows = [(i, f"https://h.org/a/{i}", f"{menu}<div>Own line</div>") for i in range(4)]
    rows += [(9, "https://h.org/a/9", f"{menu}<div>Another line</div>"), (10, "https://other.org/a/1", f"{menu}<div>Alone</div>")]
    got = {r.page_id: r.text for r in htmltext.extract(pages(spark, rows).coalesce(1)).collect()}
    assert [got[i] for i in range(4)] == ["Own line"] * 4 and got[9] == "Another line"
    assert got[10].startswith("Menu 0") and got[10].endswith("Alone")
