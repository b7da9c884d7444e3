"""Filter audit, disclosure and periodic runs against plain versions, and the defined results of odd inputs."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
                    ("part", pa.string()), ("runs", pa.string()), ("spans", pa.string()), ("content", pa.string()), ("h1", pa.int64()), ("k1", pa.int64())])


def folder(tmp_path, rows, labels=()):
    """``rows``: (doc_id, text, lang); the other columns have names that the operators use themselves."""
    cols = list(zip(*rows)) or [(), (), ()]
    n = len(rows)
    pq.write_table(pa.table([*cols, ["s"] * n, [1] * n, ["clash"] * n, ["clash"] * n, ["clash"] * n, ["clash"] * n, [1] * n, [1] * n], schema=SCHEMA),
                   tmp_path / "documents.parquet")
    lab = list(zip(*labels)) or [(), (), ()]
    pq.write_table(pa.table([list(x) for x in lab], schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())])),
                   tmp_path / "labels.parquet")
    return str(tmp_path)


def same_as_sql(spark, name, sf_dir):
    from helpdeck.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(rel.columns)
    order = [df.columns.index(c) for c in sorted(df.columns)]
    got = sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr)
    names = list(rel.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    return QUERIES[name](spark, sf_dir).collect()


RNG = random.Random(8)


def prose(n, vocabulary=400):
    return " ".join(f"w{RNG.randrange(vocabulary)}" for _ in range(n))


# ---- 11 filter interaction audit


def audit_rows():
    long_one, junk = prose(250), prose(250) + " $"
    texts = [long_one, long_one, junk, junk, "SHOUT " * 60, "a b", "", None, "", prose(400, 5), "x " * 300, "É" * 5, prose(90000)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["en", "en", "fr", "en", "fr", "", None, "en", "en", "fr", "en", "fr", "en"]))]
    rows += [(100, long_one, "fr"), (100, long_one, "fr"), (None, long_one, "en"), (None, "", None), (101, "a b", "en")]
    rows += [(200 + i, long_one, "en") for i in range(1500)]  # a group of copies that is dealt out
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 300, 2)] + [(0, 1, 1), (0, 0, None), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs = []
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, f in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                                            bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i]) if f}
        docs.append((part or "", fails, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                hit = [d for d in left if c in d[1]]
                n_fail = sum(c in d[1] for d in mine)
                left = [d for d in left if c not in d[1]]
                removed[c] = removed.get(c, 0) + len(hit)
                out[part, order, step] = [len(left), len(hit), n_fail - len(hit), sum(d[1] == {c} for d in mine),
                                          sum(d[2] for d in hit), sum(d[3] for d in hit), c]
        for k, v in out.items():
            if k[0] == part:
                v[6] = removed[v[6]]
    return out


def test_audit_matches_brute_force(spark, tmp_path):
    rows, labels = audit_rows()
    got = same_as_sql(spark, "op11_filter_audit", folder(tmp_path, rows, labels))
    want = brute_audit(rows, labels)
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in cols] for r in got} == want and len(got) == 600 * 3


def test_audit_of_nothing(spark, tmp_path):
    from helpdeck.llm.queries import QUERIES

    assert QUERIES["op11_filter_audit"](spark, folder(tmp_path, [])).count() == 0


def test_audit_marks_copies_by_text_not_by_hash(spark, tmp_path):
    """Texts that share a hash are told apart: the join compares the texts themselves."""
    from pyspark.sql import functions as F

    from helpdeck.llm.filter_audit import earlier_copies

    rows = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "p", "a"), (None, "p", "a")], "doc_id bigint, part string, text string")
    rows = rows.withColumn("h1", F.lit(7).cast("long")).withColumn("h2", F.lit(7))
    assert [r.doc_id for r in earlier_copies(rows, rows.drop("text")).collect()] == [3]


# ---- 12 disclosure


def pii_rows():
    near = [f"{prose(30)} Agent Zorblax, writes to zed.k@corp.example.com from {prose(3)}. {prose(20)}" for _ in range(4)]
    texts = near + [near[0]] * 3 + [f"the agent writes to and from {prose(5)}" for _ in range(400)]
    texts += ["(Zorblax) was seen, zorblax! " + prose(5), None, "", "   ", "clean words only",
              "a@b.c._x@d.e x@y a@b@c.dd +1 (243) 555-5526 4111 1111 1111 1111 4111111111111112 10.0.0.255 10.0.0.256 0001.2.3.4.5.6.7.8",
              "é 日本 ü@x.de tel +49-(0)30 1234567-8 ip 1.2.3.4", "+1((((((((5", "1-1-1-1-1-1-1-1-1-1-1-1", "mailto:q@r.st, Zorblax q@r.st"]
    # runs without a blank, and very many matches
    texts += ["a" * 200_000 + " k@l.mn", "9" * 50_000, "a." * 20_000 + "@b", "x@y" + ".z" * 20_000, "4929348385146306 " * 700 + "Zorblax"]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    return rows + [(0, near[0], "en"), (None, near[1], None), (None, None, None)]


def test_disclosure_matches_sql(spark, tmp_path):
    rows = pii_rows()
    got = same_as_sql(spark, "op12_disclosure", folder(tmp_path, rows))
    by = {(r.doc_id, r.base_sha256, r.spans) for r in got}
    assert len(got) == len(rows) and len({d for d, _, _ in by}) == len({d for d, _, _ in rows})
    per = {r.doc_id: r for r in got}
    t = rows[0][1]
    a, e = t.index("Zorblax"), t.index("zed.k@")
    want = f"term:{a}:{a + 7},email:{e}:{e + len('zed.k@corp.example.com')}"
    assert want in per[0].spans and per[0].n_terms >= 1 and "agent" not in [t[int(s.split(":")[1]):int(s.split(":")[2])].lower()
                                                                           for s in per[0].spans.split(",")]
    seen = next(r for r in rows if r[1] and r[1].startswith("(Zorblax)"))
    assert per[seen[0]].spans == "term:1:8,term:20:27"
    clean = next(r for r in rows if r[1] == "clean words only")
    assert per[clean[0]].spans == "" and per[8].spans == ""
    mixed = next(r for r in rows if r[1] and r[1].startswith("a@b.c._x"))
    assert (per[mixed[0]].n_email, per[mixed[0]].n_ip, per[mixed[0]].n_card, per[mixed[0]].n_phone) == (3, 3, 0, 0)  # digits that follow at one blank belong to the match, which is then too long


def test_base_spans_match_plain_patterns(spark, tmp_path):
    """Patterns as the contract states them, by another engine of regular expressions."""
    from helpdeck.llm.queries import QUERIES

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    signs = "ab1259 .-+@()%_\n"
    texts = ["".join(RNG.choice(signs) for _ in range(RNG.randrange(80))) for _ in range(600)]
    texts += ["".join(RNG.choice("0123456789 -") for _ in range(40)) for _ in range(300)] + [
        ".".join(str(RNG.randrange(300)) for _ in range(RNG.randrange(3, 10))) for _ in range(100)]

    def spans(t):
        out = []
        for no, (kind, p) in enumerate(plain.items()):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or (
                        kind == "card" and 12 <= len(d) <= 19 and luhn) or kind == "phone" and 9 <= len(d) <= 15:
                    out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
        return ",".join(x[2] for x in sorted(out))

    got = {r.doc_id: r for r in QUERIES["op12_disclosure"](spark, folder(tmp_path, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert sum(bool(spans(t)) for t in texts) > 60
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(spans(t).encode()).hexdigest(), t


def test_sanitise(spark, tmp_path):
    from helpdeck.llm.disclosure import sanitise

    rows = [(1, "Mail a.b@c.de or +1 (243) 555-5526, now", "x"), (2, None, "x"), (3, "nothing é", "x"), (None, "ip 1.2.3.4", "x")]
    rows += [(10 + i, f"{prose(10)} Glimk q{i}@r.st {prose(10)}", "x") for i in range(2)]
    rows += [(20 + i, f"{prose(10)} Vexor9 one@two.st {prose(10)}", "x") for i in range(3)] + [(30, "Vexor9 again", "x"), (31, "and Vexor9", "x")]
    rows += [(100 + i, prose(20), "x") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    out = sanitise(d)
    assert out.columns == d.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == "Mail [EMAIL] or [PHONE], now" and got[2] is None and got[3] == "nothing é" and got[None] == "ip [IP]"
    assert "Glimk [EMAIL]" in got[10]
    assert "[CODE] [EMAIL]" in got[20] and got[30] == "[CODE] again" and got[31] == "and [CODE]"  # 3 of 5 texts: generalised
    got = {r.doc_id: r.text for r in sanitise(d, remove=0.5).collect()}
    assert got[30] == " again" and got[31] == "and "
    assert sanitise(d.where("false")).count() == 0


# ---- 13 periodic runs


def brute_runs(words, least=12):
    ids = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words])
    out = {}
    for q in range(1, len(w) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (w[:-q] == w[q:]).astype(int), [0]))))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s + q >= max(least, 2 * q):
                out.setdefault((s, e + q - s), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_match_brute_force():
    from helpdeck.llm.periodic_runs import runs

    for turn in range(800):
        n = RNG.randrange(0, 220)
        block = [RNG.randrange(3) for _ in range(RNG.randrange(1, 40))]
        w = [[RNG.randrange(2) for _ in range(n)], [0] * n, [block[i % len(block)] for i in range(n)],
             sum(([RNG.randrange(2) for _ in range(RNG.randrange(1, 12))] * RNG.randrange(1, 8) for _ in range(12)), [])][turn % 4]
        if turn % 8 > 3 and n > 2:
            w[RNG.randrange(len(w))] = 9
        assert [tuple(x) for x in runs(np.array(w, np.int64)).tolist()] == brute_runs(w), w
    thirds = [0] * 300 + [1] + [0] * 301 + [2] + [0] * 299
    assert [tuple(x) for x in runs(np.array(thirds)).tolist()] == brute_runs(thirds)
    assert [tuple(x) for x in runs(np.arange(200_000) % 70_000, 20).tolist()] == [(0, 200_000, 70_000)]
    with pytest.raises(ValueError):
        runs(np.zeros(5), 6)


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_run_query_matches_brute_force(spark, tmp_path):
    from helpdeck.llm.queries import QUERIES

    texts = [prose(RNG.randrange(1, 400), 50) for _ in range(150)] + ["ab c " * 30, "a " * 11, "a " * 12, "x\x0by\x1cz " * 20, "é " * 40, None, "", " \n ",
                                                                      "w " * 30_000, " ".join(str(i % 3001) for i in range(9500))]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, "k " * 20, "en"), (3, "k " * 20, "en"), (None, "k " * 20, None), (None, None, None), (-5, prose(60), "en")]
    got = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, folder(tmp_path, rows)).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        w = planted(i, t)
        r = brute_runs(w) if len(set(w)) > 1 else [(0, len(w), 1)] if len(w) >= 12 else []
        gone = {k for s, n, q in r for k in range(s + q, s + n)}
        best = min(r, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want.append((i, len(r), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest(),
                     hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_collapse_keeps_columns(spark):
    from helpdeck.llm.periodic_runs import collapse

    d = spark.createDataFrame([(1, "so a b a b a b a b a b a b a b end", "clash"), (2, None, "clash")], "doc_id bigint, body string, runs string")
    got = collapse(d, "body").orderBy("doc_id").collect()
    assert [tuple(x) for x in got[0].runs] == [(1, 14, 2)] and got[0].collapsed == "so a b end" and got[1].runs == [] and got[1].collapsed == ""
    assert collapse(d.where("false"), "body").count() == 0
