"""Each operator against a plain version, and the defined results of odd inputs."""

import functools
import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import dedup, groups, shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, seq string, component string, host string"
RNG = random.Random(5)


def prose(n, rng=RNG, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edit(text, share, rng=RNG):
    w = text.split(" ")
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@functools.lru_cache(maxsize=1)
def corpus():
    base = [prose(RNG.randrange(60, 300)) for _ in range(12)]
    passage = prose(40)
    texts = list(base)
    for b in base[:6]:
        texts += [b, edit(b, 0.01), edit(b, 0.03), edit(b, 0.2), b[: len(b) // 2]]
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(12)]
    texts += [None, "", " \n\t ", "one", "one", "two words", "One", "a" * 3000, "ab" * 400, "é" * 260, "日本語 " * 90, "x y z w v", "x y z w v u"]
    texts += [prose(9000), "word " * 2000]
    return texts


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash", "clash", "clash") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# ---- 1 suffix-array dedup


def test_dedup_matches_brute_force(docs):
    from helpdeck.llm.suffix_dedup import dedup_digests

    got = sorted(map(tuple, dedup_digests(docs, chunk=4096, task_bytes=2048, shard_bytes=512).collect()))
    assert got == [(i, *x) for i, x in enumerate(dedup(corpus()))]


def test_dedup_crowded_anchors(docs, spark):
    """Anchors with many runs are parted: a phrase shorter than ``length``, and a longer one, between changing texts."""
    from helpdeck.llm.suffix_dedup import dedup_digests

    options = {"chunk": 4096, "task_bytes": 2048, "shard_bytes": 512, "crowd": 1}
    got = sorted(map(tuple, dedup_digests(docs, **options).collect()))
    assert got == [(i, *x) for i, x in enumerate(dedup(corpus()))]
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghij "))
    some = lambda n: "".join(rng.choice(letters, n))
    short, long, around = some(70), some(130), [some(60) for _ in range(6)]
    texts = [around[rng.integers(6)][:rng.integers(1, 60)] + (long if i % 3 else short) + around[rng.integers(6)] + some(5) for i in range(120)]
    texts += [short + short, long + long, short * 5]
    want = [(i, *x) for i, x in enumerate(dedup(texts))]
    assert sorted(map(tuple, dedup_digests(frame(spark, texts), **options).collect())) == want
    assert sorted(map(tuple, dedup_digests(frame(spark, texts), length=60, step=10, crowd=2).collect())) == [
        (i, *x) for i, x in enumerate(dedup(texts, 60))]


def test_parts_of_a_crowded_anchor_are_small():
    """Texts that have only a phrase in common do not meet in one transform."""
    from helpdeck.llm import suffix_dedup as S

    rng = np.random.default_rng(4)
    phrase = rng.integers(97, 123, 66).astype(np.uint8)
    texts = [np.concatenate((rng.integers(97, 123, 90), phrase, rng.integers(97, 123, 90))).astype(np.uint8).tobytes() for _ in range(300)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc, start, n, anchor, _ = S.runs_of(data, np.arange(301) * 246, 100)
    key = (anchor >> np.uint64(16)).view(np.int64)
    values, counts = np.unique(key, return_counts=True)
    hot = key == values[counts.argmax()]
    rows = pa.record_batch({"seq": pa.array(np.arange(300)), "text": pa.array(texts, pa.binary()), "asked": pa.array(
        [[{"start": int(s), "n": int(m), "anchor": int(k), "many": True} for s, m, k in zip(start[hot & (doc == d)], n[hot & (doc == d)], key[hot & (doc == d)])]
         for d in range(300)], pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("many", pa.bool_())])))})
    parts = pa.Table.from_batches(list(S._cut_strings(100)(iter([rows]))))
    assert counts.max() >= 30 and np.unique(parts["anchor"].to_numpy(), return_counts=True)[1].max() <= 2
    assert sum(parts["n"].to_pylist()) == n[hot].sum()


def test_transforms_hold_little_memory():
    """A task's strings are settled some at a time, so what a worker holds does not grow with its partition."""
    import inspect
    import tracemalloc

    from helpdeck.llm import suffix_dedup as S

    given = {k: v.default for k, v in inspect.signature(S.without_repeats).parameters.items()}
    rng = np.random.default_rng(2)
    n = 16000
    strings = pa.array([x.tobytes() for x in rng.integers(97, 123, (n, 150)).astype(np.uint8)], pa.binary())
    rows = pa.record_batch({"anchor": np.arange(n) // 4, "seq": np.arange(n), "start": np.zeros(n, np.int32), "n": np.full(n, 51, np.int32),
                            "bytes": strings})
    tracemalloc.start()
    try:
        list(S._merge_runs(given["length"], given["step"], given["task_bytes"], given["shard_bytes"])(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120_000_000


def test_workers_give_memory_back(monkeypatch):
    """At the end of a task, also of one that is not read to its end."""
    from helpdeck.llm import common

    class Pool:
        def release_unused(self):
            given.append(1)

    given: list[int] = []
    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    monkeypatch.setattr(common.pa, "system_memory_pool", Pool)
    assert list(common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and len(given) == 2
    task = common.lean(lambda batches: batches)(iter([1, 2]))
    next(task)
    task.close()
    assert len(given) == 4


def test_dedup_other_steps(docs):
    from helpdeck.llm.suffix_dedup import dedup_digests

    got = sorted(map(tuple, dedup_digests(docs, length=60, step=10).collect()))
    assert got == [(i, *x) for i, x in enumerate(dedup(corpus(), 60))]


def test_dedup_repeated_and_null_ids(spark, empty):
    from helpdeck.llm.suffix_dedup import dedup_digests, remove_repeats

    t = prose(50)
    got = dedup_digests(frame(spark, [t, t, t, None], [7, 7, None, None])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, len(t), len(t)]
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]
    assert dedup_digests(empty).count() == 0 and remove_repeats(empty).columns == empty.columns


def test_remove_repeats_keeps_rows_columns_and_characters(spark):
    from helpdeck.llm.suffix_dedup import remove_repeats

    t = "é" + "ü" * 5 + prose(30) + "ö"
    d = frame(spark, [t, "ä" + t + "ß", None])
    got = sorted(remove_repeats(d).collect(), key=lambda r: r.doc_id)
    assert got[0].text == t and got[1].text == "äß" and got[2].text is None
    assert got[1].n_chars == 2 and got[1].n_words == "clash" and remove_repeats(d).columns == d.columns


def test_merge_is_the_transform_of_all():
    """Interleaving shard transforms gives the order and prefixes that sorting all suffixes gives."""
    from helpdeck.llm.suffix_dedup import repeated_windows

    rng = np.random.default_rng(3)
    for _ in range(20):
        strings = [bytes(rng.choice([97, 98], rng.integers(0, 60)).astype(np.uint8)) for _ in range(int(rng.integers(1, 9)))]
        off = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        got = repeated_windows(np.frombuffer(b"".join(strings), np.uint8), off, 8, 4, 40)
        seen, want = set(), []
        for s in strings:
            for i in range(len(s)):
                w = s[i:i + 8]
                want.append(len(w) == 8 and w in seen)
                if len(w) == 8:
                    seen.add(w)
        assert got.tolist() == want


# ---- 2 fingerprints


def test_fingerprints(spark, docs, empty):
    from helpdeck.llm.fingerprint import edited, edits, fingerprint, fingerprint_frame, likeness

    texts = [t or "" for t in corpus()]
    got = {r.doc_id: r for r in fingerprint_frame(docs).collect()}
    for i, t in enumerate(texts):
        new = edited(t, texts[(i + 1) % len(texts)])
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == fingerprint(t) and r.edited_fingerprint == fingerprint(new)
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint) and 0 <= r.near_next <= 1
    assert fingerprint_frame(empty).count() == 0
    a = "\n".join(prose(30) for _ in range(40))
    lines = a.split("\n")
    lines[17] = prose(30)
    fa, fb = fingerprint(a), fingerprint("\n".join(lines))
    assert edits(fa, fb) == [(17, 18)] and 0.9 < likeness(fa, fb) < 1 and edits(fa, fa) == []


def test_successors_in_ranges(spark):
    from helpdeck.llm.fingerprint import successors

    n = 500
    d = frame(spark, [f"t{i}" for i in range(n)], [i * 7 for i in range(n)]).repartition(5)
    got = successors(d, lambda i, t, u: {"doc_id": i, "t": t, "u": u}, "doc_id bigint, t string, u string", rows_per_range=9).collect()
    assert sorted((r.doc_id, r.t, r.u) for r in got) == [(i * 7, f"t{i}", f"t{(i + 1) % n}") for i in range(n)]


def test_successors_of_large_ids(spark):
    from helpdeck.llm.fingerprint import fingerprint_frame, successors

    first = (1 << 61) + 1
    d = spark.range(first, first + 20_000).selectExpr("id doc_id", "concat('t', id) text").repartition(7)
    got = successors(d, lambda i, t, u: {"doc_id": i, "u": u}, "doc_id bigint, u string", rows_per_range=500).collect()
    assert {r.doc_id: r.u for r in got} == {i: f"t{i + 1 if i + 1 < first + 20_000 else first}" for i in range(first, first + 20_000)} and len(got) == 20_000
    edge = spark.createDataFrame([(i, str(i)) for i in (None, -(1 << 63), (1 << 63) - 1, 0)], "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in fingerprint_frame(edge).collect()) == sorted(str(i) for i in (None, -(1 << 63), (1 << 63) - 1, 0))


# ---- 3 HTML extraction

PAGES = [
    ("<title>x</title><p>One<p>Two <b>bold</b>&amp;<script>no()</script>", "One\n\nTwo bold&"),
    ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>end", "- a\n- b\n\n  3. c\n\nend"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>", "Name    N\nlonger  1"),
    ("<table><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<div>a</div><div hidden>b</div><div style='display: none'>c</div>d", "a\nd"),
    ("<pre>x\n  y</pre>z<br>q", "x\n  y\n\nz\nq"),
    ("a < b", "a < b"), ("", ""), (None, ""), ("<head><title>t</title></head><body>b</body>", "b"),
    ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n    v\nl\n    w"),
    ("<select><option>a<option>b</select>", "a\nb"),
]


def test_html(spark):
    from helpdeck.llm.html_text import extract

    rows = [(i, "u", h) for i, (h, _) in enumerate(PAGES)] + [(99, None, "<div>" * 5000 + "deep")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i].text for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert got[99].text == "deep" and got[8].n_lines == 0
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# ---- 4 language identification


def test_language(spark, empty):
    from helpdeck.llm.langid import fit, predict

    rng = random.Random(1)
    make = {"aa": "abcde", "zz": "vwxyz", "mm": "lmnop"}
    rows = [(i, " ".join("".join(rng.choices(make[k], k=5)) for _ in range(40)), k) for i, k in enumerate(sorted(make) * 60)]
    d = spark.createDataFrame([(i, t, k) for i, t, k in rows] + [(900, None, "aa"), (901, "12 34 !", "zz"), (902, "", None)], "doc_id bigint, text string, lang string")
    model = fit(d, epochs=6)
    got = {r.doc_id: r for r in predict(d, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (900, 901, 902))
    assert fit(empty) is None and predict(d, None).where("lang_pred <> 'und'").count() == 0
    one = fit(d.where("lang = 'aa'"))
    assert one.languages == ["aa"]


def test_language_ignores_labels(spark):
    from helpdeck.llm.queries import QUERIES

    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.001").collect()
    lang = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_language_needs_a_letter_and_reads_whole_texts(spark):
    from pyspark.sql import functions as F

    from helpdeck.llm.langid import fit, keep_known, predict, stretches

    words = {"aa": "gato perro casa luz", "bb": "zwölf über straße können"}
    rows = [(i, " ".join(RNG.choices(words[k].split(), k=40)), k) for i in range(80) for k in words]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    odd = spark.createDataFrame([(1, "² ①"), (2, "Ⅷ 12 _"), (3, "ª"), (4, "中")], "doc_id bigint, text string")
    got = {r.doc_id: r.lang_pred for r in predict(odd, fit(d)).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und" and got[4] != "und"
    unlabelled = d.withColumn("lang", F.lit(None).cast("string"))
    assert keep_known(unlabelled).count() == 160 and keep_known(d.limit(0)).count() == 0
    # a language that stands only at the end of long texts is found there
    long = spark.createDataFrame([(i, "x" * 9000 + "é" * 9000) for i in range(40)], "doc_id bigint, text string")
    cut = [r.t for r in long.select(stretches(F.concat("text", F.col("doc_id").cast("string")), 600).alias("t")).collect()]
    assert all(len(t) == 603 for t in cut) and {c for t in cut for c in t} >= {"x", "é"} and sum("é" in t for t in cut) > 30


# ---- 5 licence scan


def test_licenses(spark, empty):
    from helpdeck.llm.license_scan import TEMPLATES, bigrams, dice, scan, words

    texts = [prose(50) + "\n" + t + "\n" + prose(50) for _, t in TEMPLATES] + [prose(200), None, "", "MIT", TEMPLATES[4][1].replace(" ", "\n", 5)]
    got = {r.doc_id: r for r in scan(frame(spark, texts)).collect()}
    for i, (name, t) in enumerate(TEMPLATES):
        assert got[i].license == name and got[i].score == 1.0 and texts[i][got[i]["at"]:].startswith(t)
    n = len(TEMPLATES)
    assert [got[n + k].license for k in range(4)] == [None] * 4 and got[n + 4].license == "MIT"
    assert scan(empty).count() == 0
    # size bounds lose nothing: a plain comparison with every template finds the same
    for i, (_, t) in enumerate(TEMPLATES):
        best = max((dice(bigrams(words(t)), bigrams(words(u))), name) for name, u in TEMPLATES)
        assert (got[i].score, got[i].license) == best


def test_wrapped_licenses_inside_prose():
    from helpdeck.llm.license_scan import TEMPLATES, Matcher, passages, words

    matcher = Matcher(TEMPLATES, 0.8)
    for name, t in TEMPLATES:
        w, after = t.split(" "), " More text\nafter it." if t.endswith(".") else "\nMore text"
        for width in (1, 2, 3, 4, 7):
            text = "Some text before. " + "\n".join(" ".join(w[k:k + width]) for k in range(0, len(w), width)) + after
            assert (18, words(t)) in passages(text, matcher) and matcher.best(words(t)) == (1.0, name), (name, width)


# ---- 6 byte-level BPE


def test_bpe(spark, docs, empty):
    import public_tokenizers
    from helpdeck.llm.bpe import encode, encode_frame, encoding, safe_pieces

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = encoding(path, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in encode_frame(docs, path, public_tokenizers.PATTERN, piece_chars=50).collect()}
    for i, t in enumerate(corpus()):
        ids = enc.encode_ordinary(t or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(" \n\t'sS1é!　日x") for _ in range(120))
        assert encode(t, enc, 10) == enc.encode_ordinary(t) and "".join(safe_pieces(t, 10)) == t
    assert encode_frame(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_blank_runs():
    import public_tokenizers
    from helpdeck.llm.bpe import LONG_RUN, decode, encode, encoding

    enc = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(4)
    blanks = [" ", "\n", "\t", "\u3000", "\x1c", "\xa0", "\x85", "\u200b"]
    for turn in range(60):
        text = "".join(rng.choice(["ab ", "1 ", "!?", "é"]) + "".join(rng.choice(blanks if turn % 2 else " ") for _ in range(
            rng.choice([0, 1, LONG_RUN - 1, LONG_RUN, LONG_RUN + 1, 6000]))) for _ in range(5))
        text = text.strip() if turn % 3 else "\n" * 5000 + text
        assert encode(text, enc, piece_chars=2000) == enc.encode_ordinary(text)
    text = "a" + " " * 1_000_000 + "b" + "\n" * 1_000_000  # beyond what the library's matcher follows
    assert decode(encode(text, enc), enc) == text.encode()


# ---- 7 n-gram Jaccard join


@pytest.mark.parametrize("n2,k2", [(1, 0), (3, 1)])
def test_join_matches_brute_force(docs, n2, k2):
    from helpdeck.llm.jaccard_join import join_groups

    got = sorted(map(tuple, join_groups(docs, n2=n2, k2=k2).collect()))
    assert got == sorted(groups(list(enumerate(corpus()))))


def test_join_large_near_group(spark):
    """Many edits of one text, most not linked with each other: chains and dense groups."""
    from helpdeck.llm.jaccard_join import join_groups

    rng = random.Random(9)
    base = prose(120, rng, 10**6)
    texts = [edit(base, rng.choice([0.01, 0.03, 0.05]), rng) for _ in range(150)] + [base] * 30
    texts += [prose(100, rng, 10**6) + " " + " ".join(base.split(" ")[:30]) for _ in range(60)]
    got = sorted(map(tuple, join_groups(frame(spark, texts)).collect()))
    assert got == sorted(groups(list(enumerate(texts))))


def test_signatures_of_linked_sets_meet():
    from helpdeck.llm.jaccard_join import FREQUENT_BITS, odd_bits, parities, signatures

    rng = np.random.default_rng(4)
    marks = rng.random(1 << FREQUENT_BITS) < 0.3
    for n2, k2 in ((1, 0), (3, 1)):
        for _ in range(400):
            n = int(rng.integers(1, 300))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            gone = int(rng.integers(0, len(a) // 4 + 1))
            new = int(rng.integers(0, len(a) // 4 + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            assert odd_bits(parities(a), parities(b)) <= len(a) + len(b) - 2 * both
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                assert len(np.intersect1d(signatures(a, marks, n2, k2), signatures(b, marks, n2, k2)))


def test_frequent_shingles_are_counted_over_all_rows(spark):
    from helpdeck.llm.common import ship
    from helpdeck.llm.jaccard_join import FREQUENT_BITS, frequent_shingles
    from helpdeck.llm.shingles import shingle_sets

    ship(spark)
    common, rarer = "one two three four five", "six seven eight nine ten"
    texts = [common] * 40 + [rarer] * 39 + [f"a{i} b{i} c{i} d{i} e{i}" for i in range(921)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, text string").repartition(5)
    marks = frequent_shingles(rows, 1000, 100, 4)  # 4 of every 100 rows
    spots = []
    for t in (common, rarer):
        data = np.frombuffer(t.encode(), np.uint8)
        spots.append(int(shingle_sets(data, np.array([0, len(data)]))[0][0] >> np.uint64(64 - FREQUENT_BITS)))
    assert marks[spots[0]] and not marks[spots[1]] and marks.sum() == 1


def test_parities_are_short_and_tell_sets_apart():
    from helpdeck.llm.jaccard_join import odd_bits, parities

    rng = np.random.default_rng(2)
    for n in (1, 3, 100, 200, 255, 3000):
        a, b = (np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2))
        assert 8 * len(parities(a)) <= max(8, 4 * n) and odd_bits(parities(a), parities(a)) == 0
        if n >= 100:  # linked sets differ in at most 2 of 7 elements of both
            assert 7 * odd_bits(parities(a), parities(b)) > 2 * 2 * n


def test_neighbourhoods_that_leave_pairs_out_come_again():
    """Open pairs only between the 41 smallest and the 41 largest members; those in between are far from all."""
    import pyarrow as pa
    from helpdeck.llm.jaccard_join import _open_pairs

    size = [100] * 41 + [101] * 18 + [102] * 41
    bits = [b"\xff" * 64 if n == 101 else b"\0" * 64 for n in size]
    rows = pa.RecordBatch.from_arrays([pa.array([0] * 100), pa.array(range(100)), pa.array(size), pa.array(bits),
                                       pa.array([99 if n == 102 else 0 for n in size])], names=["leader", "id", "n", "bits", "component"])
    for turn in range(4):
        got = [r for b in _open_pairs(turn)(iter([rows])) for r in b.to_pylist()]
        pairs = {(r["a"], r["b"]) for r in got if r["b"] is not None}
        assert pairs and all(a < 41 and b >= 59 for a, b in pairs)
        assert (len(pairs) == 41 * 41) != any(r["b"] is None for r in got), turn


def test_large_neighbourhoods_are_compared_in_blocks(spark):
    from itertools import combinations

    from helpdeck.llm.jaccard_join import in_blocks, join_groups

    rng = random.Random(21)
    component = [0] * 60 + [60] * 25 + [rng.randrange(85, 100) for _ in range(35)]
    members = spark.createDataFrame([(7, i, 5, b"1234", c) for i, c in enumerate(component)], "leader bigint, id bigint, n bigint, bits binary, component bigint")
    places = {}
    for r in in_blocks(members, 10).collect():
        places.setdefault((r.left, r.right), []).append((r.id, r.side))
    assert max(map(len, places.values())) < 60
    met = [(min(a, b), max(a, b)) for rows in places.values() for (a, x), (b, y) in combinations(rows, 2)
           if component[a] != component[b] and (x != y or not any(z for _, z in rows))]
    assert sorted(met) == [(a, b) for a, b in combinations(range(120), 2) if component[a] != component[b]]
    base = prose(120, rng, 10**6)
    texts = [edit(base, rng.choice([0.01, 0.03, 0.05]), rng) for _ in range(150)] + [base] * 30
    got = sorted(map(tuple, join_groups(frame(spark, texts), block=12).collect()))
    assert got == sorted(groups(list(enumerate(texts))))


def test_join_odd_ids(spark, empty):
    from helpdeck.llm.jaccard_join import join_groups, keep_one_per_group

    t = prose(80)
    d = frame(spark, [t, t, "other words here", t, None], [5, 5, 6, None, 9])
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in join_groups(d).collect()}
    n = len(shingles(t))
    assert got == {(5, None, n), (None, None, n), (6, 6, 1), (9, 9, 0)}
    assert sorted(str(r.doc_id) for r in keep_one_per_group(d).collect()) == ["6", "9", "None"]
    assert join_groups(empty).count() == 0 and keep_one_per_group(d).columns == d.columns


# ---- 8 url filter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def test_url_filter(spark, tmp_path):
    from helpdeck.llm.queries import ORACLES
    from helpdeck.llm.url_filter import judge

    def link(u):
        return f'<html><LINK href="{u}" rel="canonical">'

    rows = [
        (1, "http://a.org/x", link("http://b.org/y")), (2, "http://b.org/y#f", "<meta http-equiv='refresh' content='0; url=http://q.net/es/1'>"),
        (3, "http://c.org/", link("/other")), (4, "http://c.org/other", link("//www.example.com/en/1")), (5, "http://d.org/p/q", link("r")),
        (6, "http://d.org/p/r", link("http://example.com/en/3")), (7, "http://D.org/p/r?x#y", None), (8, None, None), (9, "nothing", link("http://q.net/es/2")),
        (10, "http://example.com/en/1", ""), (11, "http://www.example.com/en/1", ""), (12, "http://sub.net/fr/1", ""), (13, "http://net", ""),
        (14, "HTTP://B.org/y", ""), (15, "http://e.org/1", link("http://e.org/2")), (15, "http://e.org/1", link("http://e.org/2")),
        (16, "http://e.org/2", link("http://e.org/3")), (17, "http://e.org/3", link("http://example.com/en/5")), (18, "http://xcom/", ""),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, host string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = sorted(map(str, (r.asDict() for r in judge(pages, rules).collect())))
    verdict = {r.page_id: (r.rule, r.verdict) for r in judge(pages, rules).collect()}
    assert verdict[1] == verdict[2] == verdict[14] == (None, "block")  # through b.org/y to q.net/es/1
    assert verdict[3] == verdict[4] == (None, "allow")
    assert verdict[5] == verdict[6] == (None, "block") and verdict[15] == verdict[17] == (None, "block")
    assert verdict[8] == verdict[9] == verdict[13] == verdict[18] == (None, "allow")
    assert verdict[10] == ("example.com/en/", "block") and verdict[11] == ("www.example.com/en/", "allow") and verdict[12] == ("net/fr/", "block")
    pages.coalesce(1).write.parquet(str(tmp_path / "p"))
    with duckdb.connect() as c:
        c.execute(f"create view pages as from '{tmp_path}/p/*.parquet'")
        c.execute(ORACLES["op8_url_filter"])
        names = [x[0] for x in c.description]
        want = [dict(zip(names, r)) for r in c.fetchall()]
    assert got == sorted(str({k: w[k] for k in ("page_id", "host", "path", "rule", "verdict", "component")}) for w in want)
    assert judge(pages.limit(0), rules).count() == 0


def test_links_are_read_as_a_browser_does():
    from helpdeck.llm.url_filter import targets

    def of(html, url="http://h.org/a/b/c?x#y"):
        return targets(url, html)

    assert of('<link rel=canonical href="https://h/p?a=1&amp;b=2">') == ["https://h/p?a=1&b=2"]
    assert of('<link rel="x Canonical" href="../d">') == ["http://h.org/a/d"] and of("<LINK HREF='./../../e/./f' REL=canonical>") == ["http://h.org/e/f"]
    assert of('<!-- <link rel=canonical href="/z"> --><script>"<link rel=canonical href=/s>"</script>') == []
    assert of('<base href="http://b.org/q/"><link rel=canonical href=r>') == ["http://b.org/q/r"] and of("<link rel=canonical href=r>") == ["http://h.org/a/b/r"]
    assert of('<meta http-equiv=Refresh content="0; URL=\'/&#x6d;&#246;\'">') == ["http://h.org/mö"] and of('<meta http-equiv=refresh content="5">') == []
    assert of('<![if x]><link rel=canonical href="//g.org"><![endif]') == ["http://g.org"] and of('<link rel=canonical href="http://[">') == []
    assert of('<link rel=canonical href="mailto:x">') == [] and of('<link rel=canonical href="/x">', "nothing") == [] and of("") == []


def test_aliases_with_two_parameters(spark):
    from helpdeck.llm.url_filter import judge

    rows = [(1, "http://a.org/1?a=1&b=2", ""), (2, "http://a.org/2", "<link rel=canonical href='/1?a=1&amp;b=2'>"),
            (3, "http://a.org/3/x", "<link rel=canonical href='../../1?a=1&#38;b=2'>"), (4, "http://q.net/es/4", "<link rel=canonical href='http://a.org/1?a=1&amp;b=2'>"),
            (5, "http://a.org/5", "<!-- <link rel=canonical href='http://q.net/es/4'> -->")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in judge(pages, spark.createDataFrame(RULES, "verdict string, host string, path string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


# ---- 9 packing


def check_packing(rows, texts, capacity):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        own = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
    for i, x in enumerate(ids):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0  # no padding at all


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, empty, capacity):
    import public_tokenizers
    from helpdeck.llm.packing import pack_frame

    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(pack_frame(docs, path, capacity=capacity, group_ids=5000).collect(), corpus(), capacity)
    assert pack_frame(empty, path).count() == 0


def test_fill_finds_the_closest_sum():
    from itertools import product

    from helpdeck.llm.packing import fill

    rng = np.random.default_rng(6)
    for _ in range(100):
        counts = np.zeros(24, np.int64)
        for length in rng.integers(3, 24, 4):
            counts[length] += int(rng.integers(1, 4))
        lengths = np.flatnonzero(counts)
        best = max(s for s in (sum(k * n for k, n in zip(lengths.tolist(), use)) for use in product(*(range(counts[x] + 1) for x in lengths))) if s <= 24)
        got = fill(counts, 24)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


def test_word_encoder_equals_the_library(spark):
    import public_tokenizers
    import pyarrow as pa
    from helpdeck.llm.packing import WordEncoder

    enc = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), limit=50)
    rng = random.Random(8)
    letters = "abcXYZ019'sté ßÀİΣσ日́\x1f\x85\xa0<|>.,!\n\t "
    texts = ["".join(rng.choice(letters) for _ in range(200)) for _ in range(60)] + ["<|endoftext|> x", "", None, "it's I'LL don't"]
    ids, off = enc.encode(pa.array(texts, pa.string()))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want
    assert len(library.encode("a <|endoftext|> b", add_special_tokens=False).ids) == 3
    texts = ["".join(rng.choice(["<|endoftext|>", " ", "a", "É", "\n", "<|", "1", "<|startoftext|>", "<|EndOfText|>"]) for _ in range(12)) for _ in range(100)]
    ids, off = enc.encode(pa.array([None, *texts, ""], pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [library.encode(t, add_special_tokens=False).ids for t in ["", *texts, ""]]


# ---- 10 quality rules


def quality_corpus():
    line = "Subscribe to our newsletter 2024 now."
    texts = []
    for i in range(70):
        texts.append("\n".join([prose(40, vocabulary=10**6), line.replace("2024", str(1000 + i)), prose(40, vocabulary=10**6)]))
    copied = "\n".join(prose(20, vocabulary=10**6) for _ in range(5))
    texts += [copied] * 60  # copies are not frequent lines
    texts += ["\n".join([f"{line} {k}" if k else line for k in [0] * 12] + [prose(12, vocabulary=10**6)])]  # depleted
    return texts + [None, "", "a b c " * 40, "dup\ndup\n \ndup", "# $ % <x>|&*" + prose(60), "\x0b\x0c x\x1cy"]


def test_quality_matches_sql(spark, tmp_path, empty):
    from helpdeck.llm.queries import ORACLES
    from helpdeck.llm.quality_lines import apply_quality, quality

    texts = quality_corpus()
    d = frame(spark, texts).drop("n_words").withColumnRenamed("seq", "n_words")
    d.coalesce(1).write.parquet(str(tmp_path / "d"))
    got = quality(d)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().toString() and "MapInArrow" not in got._jdf.queryExecution().toString()
    rows = sorted(map(tuple, got.collect()))
    with duckdb.connect() as c:
        c.execute(f"create view documents as from '{tmp_path}/d/*.parquet'")
        assert rows == sorted(c.execute(ORACLES["op10_quality_lines"]).fetchall())
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert all(kept[i] for i in range(130)) and not kept[130] and not any(kept[i] for i in (131, 132, 133, 134))
    out = {r.doc_id: r for r in apply_quality(d).collect()}
    assert set(out) == {i for i, k in kept.items() if k} and apply_quality(d).columns == d.columns
    assert out[3].text == "\n".join([texts[3].split("\n")[0], texts[3].split("\n")[2]]) and out[3].n_chars == len(out[3].text)
    assert out[100].text == texts[100]
    assert quality(empty.drop("n_words")).count() == 0


def test_lines_inside_boilerplate_blocks_are_removed(spark, tmp_path):
    from helpdeck.llm.quality_lines import apply_quality, quality

    footer = ["All rights reserved by the desk.", "Terms of use and privacy.", "Call us on 555 1234."]
    block = [f"{' '.join(prose(4, vocabulary=10**6).split())} menu" for _ in range(30)]
    texts = ["\n".join([prose(60, vocabulary=10**6), *footer]) for _ in range(60)]
    texts += ["\n".join([*block, prose(12, vocabulary=10**6)]) for _ in range(60)]
    copied = "\n".join(prose(20, vocabulary=10**6) for _ in range(5))
    d = frame(spark, texts + [copied] * 60)
    got = {r.doc_id: r for r in quality(d).collect()}
    assert all(got[i].kept and got[i].removed_words == sum(len(x.split()) for x in footer) for i in range(60))
    assert not any(got[i].kept for i in range(60, 120)) and all(got[i].kept and not got[i].removed_words for i in range(120, 180))
    d.drop("n_words").coalesce(1).write.parquet(str(tmp_path / "d"))
    with duckdb.connect() as c:
        from helpdeck.llm.queries import ORACLES

        c.execute(f"create view documents as from '{tmp_path}/d/*.parquet'")
        rows = c.execute(ORACLES["op10_quality_lines"]).fetchall()
    assert sorted(rows) == sorted(map(tuple, quality(d).collect()))
    out = {r.doc_id: r.text for r in apply_quality(d).collect()}
    assert set(out) == {*range(60), *range(120, 180)} and all(out[i] == texts[i].split("\n")[0] for i in range(60))


def test_quality_base_by_hand(spark):
    import re

    from helpdeck.llm.quality_lines import base_counts

    texts = [t for t in corpus()] + quality_corpus()[-6:] + [" ".join(random.Random(3).choices("abcd", k=300))]
    got = {r.doc_id: r for r in base_counts(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        twice = {x for x in win if win.count(x) > 1} if len(win) < 400 else {x for x, n in __import__("collections").Counter(win).items() if n > 1}
        cover = {j for k, x in enumerate(win) if x in twice for j in (k, k + 1, k + 2)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(cover)), i


# ---- pipeline


def test_quality_counts_without_translating_whole_texts(spark):
    import re

    from pyspark.sql import functions as F

    from helpdeck.llm.quality_lines import base_counts, document_lines, line_key

    texts = ["Ab1 \t c9\x0b\n\n À#B 20&\n \x0c \n$É|<x>日%*", None, "", " \n\t", "I\u0130 \U0001f600# 7"]
    d = spark.createDataFrame([(i, "h", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = base_counts(d).orderBy("doc_id")
    assert "translate" not in got._jdf.queryExecution().optimizedPlan().toString()
    words = [[w for w in re.split("[ \t-\r]+", t or "") if w] for t in texts]
    assert [(r.word_chars, r.n_symbols) for r in got.collect()] == [
        (sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x)) for w in words]
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {ord(c): "0" for c in "123456789"}
    lines = [x for t in texts for x in (t or "").split("\n")]
    keys = spark.createDataFrame([(x,) for x in lines], "x string").select(line_key(F.col("x")).alias("k"))
    assert [r.k for r in keys.collect()] == [re.sub("[ \t-\r]+", " ", x.translate(low)).strip(" ") for x in lines]
    assert sorted(r.words for r in document_lines(d).collect()) == [1, 2, 2, 3]


def test_pipeline_against_plain_stages(spark, tmp_path):
    """The filtering stages against brute force, each on its own input, then the packed ids of the last."""
    import corpus_pipeline as P

    rng = random.Random(12)
    base = [prose(rng.randrange(60, 200), rng, 3000) for _ in range(30)]
    shared = prose(60, rng, 3000)
    texts = base + [base[0], edit(base[1], 0.01, rng), prose(70, rng, 3000) + " " + shared, prose(70, rng, 3000) + " " + shared, "too short", None]
    d = frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "language_id", "near_duplicates", "repeated_passages", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/s{k}")
        old = sorted(((r.doc_id, r.text) for r in now.collect()), key=lambda r: r[0])
        new = spark.read.parquet(f"{tmp_path}/s{k}")
        if name in ("quality_rules", "language_id"):
            assert new.columns == d.columns and {r.doc_id for r in new.collect()} == set(range(len(texts) - 2))
        elif name == "near_duplicates":
            assert {r.doc_id for r in new.collect()} == {c for _, _, c in groups(old)}
        elif name == "repeated_passages":
            got = {r.doc_id: r for r in new.collect()}
            for (i, t), want in zip(old, dedup([t for _, t in old])):
                assert hashlib.sha256(got[i].text.encode()).hexdigest() == want[3]
            assert sum(shared in r.text for r in got.values()) == 1
        else:
            place = {i: k for k, (i, _) in enumerate(old)}
            rows = [type(r)(**{**r.asDict(), "doc_id": place[r.doc_id]}) for r in new.collect()]
            check_packing(rows, [t for _, t in old], 2048)
        now = new
    whole = P.run(spark, str(tmp_path))
    assert whole.columns == now.columns and whole.count() == now.count()
