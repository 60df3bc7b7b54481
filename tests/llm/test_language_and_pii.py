"""Language identification, personal data and the pipeline."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import decontaminate, language, pii, simhash

from .test_dedup_and_leaks import brute_leaks, brute_near


@pytest.fixture(scope="module")
def model(spark, small):
    return language.fit(spark.read.parquet(f"{small}/documents.parquet"))


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    k, sizes = 3, np.array([4, 1, 3])
    crf = language.Crf(["a", "b", "c"], None, None, None, rng.normal(size=k), rng.normal(size=(k, k)))
    scores = rng.normal(size=(8, k))
    starts, pairs = np.array([0, 4, 5]), np.zeros((k, k))
    got = crf.posteriors(scores, starts, sizes, pairs)
    want, want_pairs = np.zeros((8, k)), np.zeros((k, k))
    for a, n in zip(starts, sizes, strict=True):
        weights = {}
        for code in range(k**n):
            path = [code // k**t % k for t in range(n)]
            weights[tuple(path)] = np.exp(crf.first[path[0]] + sum(scores[a + t, p] for t, p in enumerate(path)) + sum(crf.step[p, q] for p, q in zip(path, path[1:], strict=False)))
        total = sum(weights.values())
        for path, w in weights.items():
            for t, p in enumerate(path):
                want[a + t, p] += w / total
            for p, q in zip(path, path[1:], strict=False):
                want_pairs[p, q] += w / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_code_switched_words(spark, model, small):
    texts = {r.lang: r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("n_chars > 800").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    first = texts["de"].split(".")[1].split()[:12]
    second = texts["fr"].split(".")[1].split()[:12]
    import pyarrow as pa

    words = language.read_words(*language.flat(pa.array([" ".join([*first, *second])])))
    p = model.posteriors(model.scores(words.distinct)[words.number], words.starts, words.sizes)
    best = [model.languages[k] for k in p.argmax(1)]
    assert best[:3] == ["de"] * 3 and best[-3:] == ["fr"] * 3


def test_chains_end_with_sentences_and_documents():
    data, offsets = language.flat(language.pa.array(["aa " * 1000, "bb. cc dd", None, "ee"]))
    words = language.read_words(data, offsets)
    assert words.sizes.tolist() == [1000, 1, 2, 1] and words.starts.tolist() == [0, 1000, 1001, 1003]


@pytest.mark.parametrize("piece", [1, 3, 64, 5000])
def test_messages_pass_between_pieces(piece):
    """A chain of 1,000 words in pieces gives what a plain walk over the whole chain does."""
    rng, k = np.random.default_rng(3), 3
    field = language.Crf(list("abc"), None, None, None, rng.normal(size=k), rng.normal(size=(k, k)) * 2)
    sizes = np.array([1000, 1, 64, 65, 130])
    starts, scores = np.concatenate([[0], np.cumsum(sizes)[:-1]]), rng.normal(size=(sizes.sum(), k)) * 2
    pairs = np.zeros((k, k))
    got = field.posteriors(scores, starts, sizes, pairs, piece)
    step, want_pairs = np.exp(field.step), np.zeros((k, k))
    for a, n in zip(starts, sizes, strict=True):
        local, ahead, behind = np.exp(scores[a : a + n]), np.zeros((n, k)), np.ones((n, k))
        for t in range(n):
            now = local[t] * (ahead[t - 1] @ step if t else np.exp(field.first))
            ahead[t] = now / now.sum()
        for t in range(n - 2, -1, -1):
            now = step @ (local[t + 1] * behind[t + 1])
            joint = ahead[t][:, None] * step * (local[t + 1] * behind[t + 1])
            behind[t], want_pairs = now / now.sum(), want_pairs + joint / joint.sum()
        both = ahead * behind
        assert np.allclose(got[a : a + n], both / both.sum(1, keepdims=True), atol=1e-9)
    assert np.allclose(pairs, want_pairs, atol=1e-6)


def test_language_of_edge_cases(edge_docs, no_docs, model, edge_texts):
    rows = language.identify(edge_docs, model).collect()
    assert len(rows) == len(edge_texts)
    for r in rows:
        lettered = bool(re.search(r"[^\W\d_]", r.text or ""))
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1 and (r.score == 0) == (not lettered)
    assert language.identify(no_docs, model).count() == 0
    assert {r.lang_pred for r in language.identify(edge_docs, None).collect()} == {"und"}
    assert language.fit(no_docs) is None


def test_every_language_is_learned(spark):
    """However many documents a language has, some are drawn; one of long documents only is learned from their beginnings."""
    assert language.drawn(120, 10**10) / 2**63 * 10**10 == pytest.approx(120) and language.drawn(120, 50) == 2**63 - 1
    docs = spark.createDataFrame([(k, "the house is green and old " * 3, "en") for k in range(9)] + [(100 + k, "das Haus ist alt und grau " * 2000, "de") for k in range(9)], "doc_id long, text string, lang string")
    assert language.fit(docs).languages == ["de", "en"]


def test_mixed_texts_stay(spark, small, monkeypatch):
    monkeypatch.setattr(language, "fit", lambda docs: None)
    monkeypatch.setattr(language, "identify", lambda docs, model: docs.withColumns({"lang_pred": F.lit("de"), "score": F.lit(0.26)}))
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert corpus_pipeline.language_id(spark, docs, small).count() == 1


def test_held_out_accuracy(spark, small):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = language.op6_language(spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    judged = [r.lang_pred == docs[r.doc_id] for r in rows if r.held_out and docs[r.doc_id] is not None]
    assert np.mean(judged) > 0.95


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PRIVATE = [
    "mail a.b@c.de, a@b.c_x@d.e and x@y or @z.com 🙂 q%w+e@a-b.co.uk.", "ips 1.2.3.4 256.1.1.1 1.2.3.4.5 0001.002.03.255 1..2.3.4 300.1.2.3.4", "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 0000000000000", "call +1 (803) 555-5351 or +44 20 7946 0958, +12 3", "no data at all", "",
    "9" * 9000 + " +" + "1" * 5000, "a@b.cc " * 3000, "user at example dot com and (803) 555-5351", "x" * 5_000 + "@" + "y" * 5_000, None, "é1.2.3.4é\n+49 89 1234567\n",
]


@pytest.fixture(scope="module")
def private(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(PRIVATE)] + [(0, PRIVATE[0], "x")], "doc_id long, text string, base string")


def test_base_spans_against_python(private):
    for r in pii.find(private).collect():
        assert sorted((s.start, s.kind, s.end) for s in r.base) == base(r.text) and r.added == []


def test_redaction(private):
    rows = pii.find(private).withColumn("clean", pii.redact("text", "base", "added")).collect()
    clean = {r.doc_id: r.clean for r in rows}
    assert clean[4] == PRIVATE[4] and clean[5] == "" and clean[10] is None
    assert clean[11] == "é[IP]é\n[PHONE]\n" and clean[0].startswith("mail [EMAIL], [EMAIL]") and "4111" not in clean[2].split(",")[0]


LOOSE_FORMS = {
    "email": [f"jane{at}example{dot}com" for at in ("@", " @ ", " @", "@ ", "[at]", " (at) ", "(at) ", " at ") for dot in (".", ". ", " .", "[dot]", " (dot) ", " dot ")],
    "ip": ["1.2.3.4", "10 . 0 . 0 . 1", "10. 0. 0. 1", "10 .0 .0 .1", "10[.]0[.]0[.]1", "10(.)0.0.1", "10.0[.]0.1"],
    "card": ["4111 1111 1111 1111", "3782-822463-10005", "4111 - 1111", "4111. 1111./1111", "4111_11_22"],
    "phone": ["(803)555-5351", "(803) 555-5351", "803-555-5351", "803.555.5351", "803 555 5351", "(803)555.5351"],
}


def test_loose_matches_pass_their_gate_alone(spark):
    texts = [(kind, t) for kind, forms in LOOSE_FORMS.items() for t in forms if re.search(pii.LOOSE[kind], t)]
    assert len(texts) >= 64
    for r in pii.candidates(spark.createDataFrame(texts, "want string, text string")).collect():
        kind = pii.KINDS.index(r.want)
        assert re.search(pii.LOOSE_GATE[r.want], r.text) and [(c.start, c.end) for c in r.more if c.kind == kind] == [(0, len(r.text))], r.text


def test_candidates_know_their_surroundings(spark):
    row = pii.candidates(spark.createDataFrame([("é call 803-555-5351, or jane (at) b.cc; end",)], "text string")).first()
    assert [(c.kind, c.start, c.end, c.s, c.before, c.after) for c in row.more] == [(0, 24, 38, "jane (at) b.cc", "é call 803-555-5351, or ", "; end"), (2, 7, 19, "803-555-5351", "é call ", ", or jane (at) b.cc; end"), (3, 7, 19, "803-555-5351", "é call ", ", or jane (at) b.cc; end")]


@pytest.fixture(scope="module")
def trees(spark):
    """Fitted on sf0.1: a kind needs ten held-out spans for its threshold."""
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_format_and_context_decide(trees):
    used = {pii.FEATURES[int(k)] for t in trees.trees for k in re.findall(r"feature (\d+)", t.toDebugString)}
    assert len(used & set(pii.FORMAT)) >= 3 and len(used & set(pii.CONTEXT_FEATURES)) >= 2, used
    assert len(trees.trees) == pii.TREES and set(trees.least) == {0, 1, 2, 3}


def test_a_rerun_fits_the_same_trees(trees, spark):
    again = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(5))
    assert again.least == pytest.approx(trees.least) and [t.toDebugString.split("\n", 1)[1] for t in again.trees] == [t.toDebugString.split("\n", 1)[1] for t in trees.trees]


def card(rng):
    own = "4" + "".join(map(str, rng.integers(0, 10, 14)))
    return own + next(c for c in "0123456789" if luhn(own + c))


def hidden(rng, kind):
    """Data as people hide it, also in ways that no rewriting of the fit makes."""
    a, b = "".join(rng.choice(list("abcdefgh"), 6)), "".join(rng.choice(list("klmnop"), 5))
    ip, c, d = rng.integers(1, 256, 4).tolist(), card(rng), rng.integers(200, 999, 3).tolist()
    forms = {
        "email": [f"{a}.{b} [at] {b}.org", f"{a} @ {b}.com", f"{a}(at){b}.co.uk", f"{a} at {b} dot net", f"{a}[at]{b}[dot]com"],
        "ip": [s.join(map(str, ip)) for s in ("[.]", " . ", "(.)")],
        "card": [s.join(c[k : k + 4] for k in range(0, 16, 4)) for s in (".", "_", "/", " - ")],
        "phone": [f"({d[0]}) {d[1]}-5{d[2]}", f"{d[0]}-{d[1]}-5{d[2]}", f"{d[0]}.{d[1]}.5{d[2]}", f"{d[0]} {d[1]} 5{d[2]}"],
    }[kind]
    return forms[int(rng.integers(len(forms)))]


def alike(rng, kind):
    a, n = "".join(rng.choice(list("abcdefgh"), 6)), rng.integers(10, 99, 6).tolist()
    forms = {"email": [f"meet at {a}.org", f"{n[0]} @ {n[1]}.50"], "ip": [f"version {n[0]}. {n[1]}. {n[2]}. {n[3]}", f"{n[0]} . {n[1]} . {n[2]} . {n[3]} . {n[4]}"], "card": [f"{n[0]}{n[1]}-{n[2]}-{n[3]}{n[4]}", f"{n[0]}1.{n[1]}.{n[2]}123.{n[3]}4"], "phone": [f"order {n[0]}1 {n[1]}2 {n[2]}{n[3]}", f"{n[0]}1-{n[1]}2-{n[2]}{n[3]}-{n[4]}"]}[kind]
    return forms[int(rng.integers(len(forms)))]


def test_hidden_data_is_found_and_look_alikes_are_not(trees, spark):
    """Precision and recall over spans put into documents that have none, between random words."""
    rng = np.random.default_rng(5)
    clean = [r.text.split(" ") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text and 30 < len(r.text) < 4000 and not base(r.text)][:400]
    rows, want = [], {}
    for k, words in enumerate(clean):
        kind, real = pii.KINDS[k % 4], k % 8 < 4
        own, at = (hidden if real else alike)(rng, kind), int(rng.integers(1, len(words)))
        left = " ".join(words[:at]) + " "
        rows.append((k, left + own + " " + " ".join(words[at:])))
        want[k] = (k % 4, len(left), len(left) + len(own)) if real else None
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.added} for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), "text", trees).collect()}
    added = sum(map(len, got.values()))
    right = sum(want[k] in spans for k, spans in got.items())
    assert right / sum(w is not None for w in want.values()) >= 0.9 and right / added > 0.98, (right, added)


def test_clean_documents_stay(trees, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = pii.find(docs, "text", trees).collect()
    assert sum(len(r.added) for r in found) <= 1 and sum(len(r.base) for r in found) > 50


def test_added_spans_touch_nothing(trees, spark):
    texts = ["jane @ b.org and a@b.cc, 1[.]2[.]3[.]4 then 1.2.3.4, (803) 555-5351 +1 (803) 555-5351", "x at y dot org 803-555-5351 4111.1111.1111.1111"]
    for r in pii.find(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), "text", trees).collect():
        base_, added = ([(s.start, s.end) for s in spans] for spans in (r.base, r.added))
        assert all(a[1] <= b[0] or b[1] <= a[0] for a in added for b in base_)
        assert all(a[1] <= b[0] for a, b in zip(sorted(added), sorted(added)[1:], strict=False))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6), st.booleans(), st.integers(0, 9)), max_size=14))
def test_the_better_of_touching_spans_stays(spark, spans):
    given_ = [(a, a + n, real, score / 4) for a, n, real, score in spans]
    base_, scored = [(a, b) for a, b, real, _ in given_ if real], sorted({(a, k % 4, b, s) for k, (a, b, real, s) in enumerate(given_) if not real})
    want, held = [], None
    for c in [c for c in scored if not any(c[0] < b and a < c[2] for a, b in base_)]:
        if held is None or c[0] >= held[2]:
            want += [held] if held else []
            held = c
        elif c[3] > held[3]:
            held = c
    want += [held] if held else []
    df = spark.createDataFrame([([(0, a, b) for a, b in base_], [(k, a, b, s) for a, k, b, s in scored])], "b array<struct<kind:int,start:int,end:int>>, m array<struct<kind:int,start:int,end:int,score:double>>")
    assert [(r.start, r.kind, r.end, r.score) for r in df.select(pii.apart("b", "m").alias("x")).first().x] == want


def test_very_many_spans_in_one_text(trees, spark):
    """Near linear: quadratic handling would not end within the limit of a test run."""
    many = " ".join(f"{k % 250}.{k % 199}.{k % 37}.7 a{k}@b.cc" for k in range(20_000))
    runs = "9" * 1_000_000 + " a@b.cc +12" + " " * 1_000_000 + "x" * 1_000_000 + ". 1.2.3.4" + "\n" * 1_000_000
    rows = pii.find(spark.createDataFrame([(1, many), (2, runs)], "doc_id long, text string"), "text", trees).withColumn("clean", pii.redact("text", "base", "added")).orderBy("doc_id").collect()
    assert len(rows[0].base) == 40_000 and rows[0].clean == " ".join(["[IP] [EMAIL]"] * 20_000)
    assert [(s.kind, runs[s.start : s.end]) for s in rows[1].base] == [(0, "a@b.cc"), (1, "1.2.3.4")]


def test_other_columns_stay(trees, spark):
    row = pii.find(spark.createDataFrame([(1, "a@b.cc", "kept", "gone")], "doc_id long, text string, more string, added string"), "text", trees).first()
    assert row.more == "kept" and row.added == [] and len(row.base) == 1 and len(row) == 5


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    """A text of a third of all rows counts once."""
    seen = []
    labelled = pii.labelled
    monkeypatch.setattr(pii, "labelled", lambda docs, text="text": seen.append(docs.count()) or labelled(docs, text))
    docs = spark.createDataFrame([(k, f"mail a{k}@b.cc, ip 1.2.3.{k} or 999.1.1.{k}") for k in range(200)] + [(1000 + k, "mail a@b.cc") for k in range(100)], "doc_id long, text string")
    pii.fit(docs)
    assert seen == [201]


def test_pii_of_edge_cases(edge_docs, no_docs):
    assert pii.find(edge_docs).count() == edge_docs.count()
    assert pii.find(no_docs).count() == 0 and pii.fit(no_docs) is None


def test_pii_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    frame = pii.op9_pii(spark, small)
    assert not any(x in frame._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    for r in frame.collect():
        want = base(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_pipeline_stages_against_brute_force(spark, small, tmp_path):
    """Each stage is judged on its own input: what it kept, and what it changed."""
    given = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    extra = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "12 !!", "en", "s", 5), (10**6 + 2, "some words " + items[0][1], "en", "s", 9)], given.schema)
    docs, columns = given.limit(120).unionByName(extra), given.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        ids = sorted(r.doc_id for r in after)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "language_id":
            assert ids == sorted(r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or ""))
        elif name == "near_dedup":
            assert ids == brute_near([r.text for r in before], [r.doc_id for r in before])
        elif name == "decontaminate":
            assert ids == sorted(r.doc_id for r in before if not brute_leaks(r.text, items)[1]) and 10**6 + 2 not in ids
        elif name == "pii":
            assert ids == sorted(r.doc_id for r in before) and not any(base(r.text) for r in after)
            same = {r.doc_id: r.text for r in before if not base(r.text)}
            assert sum(r.text != same[r.doc_id] for r in after if r.doc_id in same) <= 2
        else:
            texts = {r.doc_id: r.text for r in before}
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in after)


def test_pipeline_names():
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5 and decontaminate and simhash
