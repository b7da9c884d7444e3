"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpdeck.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.suffix_dedup import dedup_digests

    return dedup_digests(table(spark, sf_dir, "documents"))


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.fingerprint import fingerprint_frame

    return fingerprint_frame(table(spark, sf_dir, "documents"))


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def learnable():
    """Rows that a model may learn from; the others are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(True))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.langid import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable())
    return predict(docs.select("doc_id", "text", (~learnable()).alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score", "accepted")


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from helpdeck.llm.bpe import encode_frame

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_frame(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.jaccard_join import join_groups

    return join_groups(table(spark, sf_dir, "documents"))


#: Fixed by the contract.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]

_OP8_SQL = r"""
WITH RECURSIVE rules(v, rh, rp) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'),
  ('block','net','/es/'), ('block','net','/fr/')),
named AS (
  SELECT url, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]*)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]*)', 1)]) t
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
absolute AS (
  SELECT url, CASE WHEN t = '' OR NOT regexp_matches(url, '^[^/?#]*://') THEN NULL
    WHEN contains(t, '://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^/?#]*:)//', 1) || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) || t
    WHEN regexp_extract(url, '^([^/?#]*://[^/?#]*/(?:[^?#]*/)?)', 1) = '' THEN regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) || '/' || t
    ELSE regexp_extract(url, '^([^/?#]*://[^/?#]*/(?:[^?#]*/)?)', 1) || t END AS t FROM named),
addr AS (SELECT DISTINCT u, lower(regexp_extract(split_part(u, '#', 1), '^([^/?]*://[^/?]*)', 1))
    || substr(split_part(u, '#', 1), 1 + length(regexp_extract(split_part(u, '#', 1), '^([^/?]*://[^/?]*)', 1))) a
  FROM (SELECT url u FROM absolute UNION SELECT t FROM absolute UNION SELECT url FROM pages) WHERE u IS NOT NULL),
edge AS (SELECT DISTINCT x.a a, y.a b FROM absolute n JOIN addr x ON n.url = x.u JOIN addr y ON n.t = y.u WHERE x.a <> y.a),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
sites AS (SELECT u, lower(regexp_extract(u, '://([^/?#]*)([^?#]*)', 1)) h, regexp_extract(u, '://([^/?#]*)([^?#]*)', 2) p
  FROM (SELECT DISTINCT u FROM (SELECT url u FROM pages UNION SELECT b FROM both_ways)) WHERE u IS NOT NULL),
fits AS (SELECT u, rh || rp rule, v, row_number() OVER (PARTITION BY u ORDER BY length(rh || rp) DESC, length(rh) DESC, v) k
  FROM sites JOIN rules ON (h = rh OR ends_with(h, '.' || rh)) AND starts_with(p, rp)),
best AS (SELECT u, rule, v FROM fits WHERE k = 1),
said AS (SELECT r.a, min(r.b) AS least, bool_or(v = 'allow') al, bool_or(v = 'block') bl FROM reach r LEFT JOIN best ON best.u = r.b GROUP BY r.a)
SELECT page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1)) AS host,
  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path, rule,
  coalesce(best.v, CASE WHEN al THEN 'allow' WHEN bl THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(least, addr.a) AS component
FROM pages LEFT JOIN best ON best.u = url LEFT JOIN addr ON addr.u = url LEFT JOIN said ON said.a = addr.a
"""


@query("op8_url_filter", _OP8_SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.url_filter import judge

    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages"), rules)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.packing import pack_frame

    return pack_frame(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


_OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, source host, coalesce(text, '') t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) i,
    unnest(list_transform(list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:len(w)]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) g
  FROM d WHERE len(w) >= 3),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) c FROM win),
cover AS (SELECT rid, count(DISTINCT j) n FROM (SELECT rid, unnest([i, i + 1, i + 2]) j FROM rep WHERE c > 1) GROUP BY rid),
raw AS (SELECT rid, doc_id, host, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
ln AS (SELECT rid, doc_id, host, t, unnest(range(len(ls))) i, unnest(ls) l FROM raw),
norm AS (SELECT rid, doc_id, host, t, i, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) nw, trim(regexp_replace(translate(l,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') k FROM ln),
hit AS (SELECT host, k FROM norm GROUP BY host, k HAVING count(DISTINCT t) > 50),
gone AS (SELECT rid, sum(nw) FILTER (WHERE hit.k IS NOT NULL) r, sum(nw) n FROM norm LEFT JOIN hit
  ON hit.k = norm.k AND hit.host IS NOT DISTINCT FROM norm.host GROUP BY rid),
dup AS (SELECT rid, len(ls) - len(list_distinct(ls)) n FROM raw),
base AS (SELECT d.rid, doc_id, len(w)::BIGINT n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, coalesce(dup.n, 0)::BIGINT n_dup_lines,
    coalesce(cover.n, 0)::BIGINT n_repeat_words, coalesce(r, 0)::BIGINT removed_words, coalesce(gone.n, 0)::BIGINT all_words
  FROM d LEFT JOIN cover USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (removed_words > 0 AND all_words - removed_words < 0.3 * all_words) AS kept,
  removed_words FROM base
"""


@query("op10_quality_lines", _OP10_SQL)
def op10_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.quality_lines import quality

    return quality(table(spark, sf_dir, "documents"))


_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, doc_id, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(least < doc_id, false)] fails
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, fails, coalesce(good, false) good, coalesce(toxic, false) toxic FROM f LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) c, unnest([1, 2, 3, 4, 5]) i),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
y AS (SELECT part, fails, count(*) n, count(*) FILTER (WHERE good) g, count(*) FILTER (WHERE toxic) x FROM x GROUP BY part, fails),
steps AS (SELECT part, filter_order, step, o[step] mine, n, g, x, fails,
    fails[o[step]] AS hit, coalesce(list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])), false) AS gone
  FROM y, orders, (SELECT unnest(range(1, 6)) step)),
r AS (SELECT part, filter_order, step, mine, sum(n) FILTER (WHERE NOT hit AND NOT gone) AS kept, sum(n) FILTER (WHERE hit AND NOT gone) AS removed,
    sum(n) FILTER (WHERE hit AND gone) AS redundant, sum(n) FILTER (WHERE hit AND len(list_filter(fails, lambda v: v)) = 1) AS unique_fails,
    sum(g) FILTER (WHERE hit AND NOT gone) AS good_lost, sum(x) FILTER (WHERE hit AND NOT gone) AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, mine))::BIGINT AS shapley FROM r
"""


@query("op11_filter_audit", _OP11_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.periodic_runs import plant, run_digests

    return run_digests(plant(table(spark, sf_dir, "documents").select("doc_id", "text")))


_OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t, md5(coalesce(text, '')) c FROM documents),
cut AS (CUTS),
hits AS (SELECT rid, c, kn, kind, g, i, h[i] m, sum(length(g[i]) + length(h[i])) OVER (PARTITION BY rid, kn ORDER BY i) e
  FROM (SELECT *, unnest(range(1, len(h) + 1)) i FROM cut)),
num AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') n FROM hits),
spans AS MATERIALIZED (SELECT rid, c, kn, kind, g, i, (e - length(m))::BIGINT s, e::BIGINT e, kind || ':' || CASE WHEN kn < 2 THEN lower(m) ELSE n END entity FROM num
  WHERE kn = 0 OR (kn = 1 AND list_bool_and(list_transform(string_split(m, '.'), lambda p: p::DOUBLE <= 255)))
    OR (kn = 2 AND length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(n)), lambda j:
      CASE WHEN j % 2 = 0 THEN n[length(n) - j]::INT WHEN n[length(n) - j]::INT > 4 THEN 2 * n[length(n) - j]::INT - 9 ELSE 2 * n[length(n) - j]::INT END)) % 10 = 0)
    OR (kn = 3 AND length(n) BETWEEN 9 AND 15)),
sides AS (SELECT rid, c, entity, i, kn, unnest([0, 1]) side, unnest([i, i + 1]) gi, g FROM spans),
pieces AS (SELECT rid, c, entity, i, kn, side, gi, len(g) ng, unnest(string_split_regex(lower(g[gi]), '[\x20\x09-\x0D]+')) w,
    unnest(range(1, len(string_split_regex(g[gi], '[\x20\x09-\x0D]+')) + 1)) j, len(string_split_regex(g[gi], '[\x20\x09-\x0D]+')) nj FROM sides),
inner_words AS (SELECT *, trim(w, '.,;:!?"''`()[]{}<>|*#&%$=~_/\-') term FROM pieces WHERE (j > 1 OR gi = 1) AND (j < nj OR gi = ng)),
ranked AS (SELECT c, entity, term, row_number() OVER (PARTITION BY rid, kn, i, side ORDER BY CASE WHEN side = 0 THEN -j ELSE j END) r
  FROM inner_words WHERE (regexp_matches(term, '[a-z]') OR strlen(term) > length(term)) AND NOT contains(term, '@')),
pairs AS MATERIALIZED (SELECT entity, term, count(DISTINCT c) n_both FROM ranked WHERE r <= 8 GROUP BY ALL HAVING count(DISTINCT c) >= 3),
holds AS (SELECT entity, count(DISTINCT c) n_entity FROM spans GROUP BY entity),
raw AS (SELECT rid, c, string_split_regex(t, '[\x20\x09-\x0D]+') p, list_concat(regexp_extract_all(t, '[\x20\x09-\x0D]+'), ['']) b FROM d),
placed AS (SELECT rid, c, p[k] w, trim(lower(p[k]), '.,;:!?"''`()[]{}<>|*#&%$=~_/\-') term,
    sum(length(p[k]) + length(b[k])) OVER (PARTITION BY rid ORDER BY k) - length(p[k]) - length(b[k]) o
  FROM (SELECT *, unnest(range(1, len(p) + 1)) k FROM raw)),
words AS MATERIALIZED (SELECT rid, c, term, (o + length(w) - length(ltrim(w, '.,;:!?"''`()[]{}<>|*#&%$=~_/\-')))::BIGINT s,
    length(trim(w, '.,;:!?"''`()[]{}<>|*#&%$=~_/\-')) n FROM placed WHERE term IN (SELECT term FROM pairs)),
seen AS (SELECT term, count(DISTINCT c) n_term FROM words GROUP BY term),
every AS (SELECT count(DISTINCT t) n_all FROM d WHERE t <> ''),
told AS (SELECT DISTINCT term FROM pairs JOIN holds USING (entity) JOIN seen USING (term), every WHERE n_entity < n_all
  AND least(n_both / n_term, 1) >= 0.5 AND 1 + ln(least(n_both / n_term, 1)) / ln(n_all / n_entity) >= 0.8),
telling AS MATERIALIZED (SELECT rid, s, s + n e FROM words SEMI JOIN told USING (term)),
covered AS (SELECT DISTINCT w.rid, w.s FROM telling w JOIN spans x ON x.rid = w.rid AND x.s < w.e AND w.s < x.e),
more AS (SELECT rid, 4 kn, 'term' kind, s, e FROM telling ANTI JOIN covered USING (rid, s)),
everything AS (SELECT rid, kn, kind, s, e FROM spans UNION ALL SELECT * FROM more),
per AS (SELECT rid, count(*) FILTER (WHERE kn = 0) a, count(*) FILTER (WHERE kn = 1) b, count(*) FILTER (WHERE kn = 2) card, count(*) FILTER (WHERE kn = 3) f,
    count(*) FILTER (WHERE kn = 4) x, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kn) FILTER (WHERE kn < 4) base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kn) al FROM everything GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_email, coalesce(b, 0) AS n_ip, coalesce(card, 0) AS n_card, coalesce(f, 0) AS n_phone, coalesce(x, 0) AS n_terms,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(al, '') AS spans FROM d LEFT JOIN per USING (rid)
"""

_OP12_SQL = _OP12_SQL.replace("CUTS", " UNION ALL ".join(
    f"SELECT rid, c, {i} kn, '{k}' kind, string_split_regex(t, '{p}') g, regexp_extract_all(t, '{p}') h FROM d WHERE regexp_matches(t, '{p}')"
    for i, (k, p) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                                ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")])))


@query("op12_disclosure", _OP12_SQL)
def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helpdeck.llm.disclosure import disclosure_digests

    return disclosure_digests(table(spark, sf_dir, "documents"))
