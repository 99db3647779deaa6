"""One thin query for each operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import chat_format, decontaminate, fill_in_middle, hard_negatives, language_id, near_dedup, packing, pii, quality_rules, secret_scan, suffix_dedup, tiered_packing, url_filter
from quadrat.llm.common import table

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    quoted = ", ".join("(" + ", ".join(x if isinstance(x, str) and x.startswith("r'") else repr(x) for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({names})")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _values(spark, "host, path, verdict", URL_RULES)
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, host, path, max({'n': length(rh || rp), 'rule': rh || rp, 'v': v}) FILTER (WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS b
      FROM h CROSS JOIN r GROUP BY ALL)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"r'\### Assistant: </turn> ok'"
    planted = _values(spark, "conv_id, turn, role, text", [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    planted = planted.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digests(chat_format.conversations(turns))


OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
n AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, CASE WHEN i = 1 THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant'
                     WHEN prev = 'assistant' THEN role = 'user' ELSE false END AS ok FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(role) + length(text) + len(regexp_extract_all(text, '[\\#<]')) + len(regexp_extract_all(role, '[\\#<:]')))::BIGINT AS formatted_chars,
       bool_and(ok) AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM m GROUP BY conv_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality_rules.judge(book, quality_rules.STANDARD)
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.BASE.mask)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


QUALITY_SQL = r"""
w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
s AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM s) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d CROSS JOIN range(5) AS r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
q AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
              + (CASE WHEN n_words > 0 AND 2 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
              + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) THEN 16 ELSE 0 END) AS failed FROM m)
"""
OP8_SQL = f"WITH {QUALITY_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM q"


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), path="doc_id")
    return secret_scan.digests(rows).withColumnRenamed("path", "doc_id")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind -> pattern and what a match must be; spans are told by the texts between the matches.
OP3_KINDS = {
    "assign": ("(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"\x27]?\x20*[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)", "length(g) >= 12"),
    "access": ("AKIA[A-Z0-9]+", "length(m) >= 18"),
    "hex": ("[0-9a-f]+", "length(m) >= 16"),
    "private_key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    "code_host_token": (r"\bgh[opsur]_[A-Za-z0-9]{36,}", "true"),
    "chat_token": (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    "web_token": (r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
}
_MATCHES = """SELECT doc_id, {k} AS k, '{kind}' AS kind, ms[i] AS m, {group} AS g, (list_sum(list_slice(gaps, 1, i)) + coalesce(list_sum(list_slice(sizes, 1, i - 1)), 0))::BIGINT AS a
FROM (SELECT doc_id, ms, gs, sizes, gaps, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, {groups} AS gs, list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS sizes,
                   list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps FROM d))"""
_EACH = " UNION ALL ".join(
    f"SELECT doc_id, k, kind, a, a + length(m) AS z FROM ({_MATCHES.format(k=k, kind=kind, p=p, group='gs[i]' if k == 0 else 'NULL', groups=f'regexp_extract_all(t, {chr(39)}{p}{chr(39)}, 2)' if k == 0 else 'NULL')}) WHERE {rule}"
    for k, (kind, (p, rule)) in enumerate(OP3_KINDS.items())
)
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_EACH}),
o AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
             string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""


PII_KEY = "production key of the deployment"  # a parameter; set your own


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.fold(F.col("doc_id")) == 2
    profiles = language_id.fit(docs.where(~held))
    found = language_id.predict(docs.select("doc_id", "text"), profiles)
    return found.select(F.col("key").alias("doc_id"), (language_id.fold(F.col("key")) == 2).alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_langs"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, _ = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.withColumnRenamed("key", "doc_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, base, substr(h, 2 * base + 1, 1098) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 500)) AS base FROM d)),
g AS (SELECT doc_id, base + q AS p, substr(h, 2 * q + 1, 100) AS g FROM (SELECT doc_id, base, h, unnest(range(0, length(h) // 2 - 49)) AS q FROM part)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
hit AS (SELECT doc_id, p FROM g JOIN f ON f.g = g.g WHERE first < doc_id),
n AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM hit),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM n) GROUP BY doc_id, k),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM r UNION ALL SELECT d.doc_id, coalesce(max(z), 0), max(length(h) // 2) FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id),
k AS (SELECT gap.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id),
s AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN k ON k.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.other),
m AS (SELECT doc_id, min(other) AS component_id FROM c GROUP BY doc_id)
SELECT m.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.verdict().alias("contaminated"),
    )


HITS_SQL = r"""
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
im AS (SELECT item, ws, least(13, len(ws)) AS m FROM iw WHERE len(ws) > 0),
iv AS (SELECT DISTINCT item, m, list_slice(ws, i, i + m - 1) AS g FROM (SELECT item, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM im)),
dv AS (SELECT doc_id, m, i, list_slice(ws, i, i + m - 1) AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw CROSS JOIN (SELECT DISTINCT m FROM im) WHERE len(ws) >= m)),
hit AS (SELECT doc_id, i, dv.m AS m, item FROM dv JOIN iv ON dv.m = iv.m AND dv.g = iv.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
con AS (SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id)
"""
OP10_SQL = f"WITH {HITS_SQL} SELECT * FROM con"



def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select(F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM r),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), F.col("id") % 100 == 0, label=label)


OP12_SQL = """
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor, id AS positive, score AS p FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor, positive, p, s.id AS negative, s.score AS score, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p <= 100 * s.score AND 100 * s.score <= 90 * p)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, negative AS negative_id, p AS positive_score, score AS negative_score FROM n WHERE rank <= 10
"""


def op13_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, _ = tiered_packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.withColumnRenamed("key", "doc_id").drop("ids")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_pii": op2_pii,
    "op3_secret_scan": op3_secret_scan,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_dedup": op9_near_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_tiered_packing": op13_tiered_packing,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op3_secret_scan": OP3_SQL, "op4_chat_format": OP4_SQL, "op7_suffix_dedup": OP7_SQL, "op8_quality_rules": OP8_SQL, "op9_near_dedup": OP9_SQL, "op10_decontaminate": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_hard_negatives": OP12_SQL}
