"""Registered queries of the training-data operators: name -> f(spark, sf_dir).

Each query reads its whole table, applies one operator with production
parameters and returns the full result; ``SQL`` has the DuckDB twins of the
queries that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
         ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * x >= 80 * (na.n + nb.n - x)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.v FROM r JOIN e ON r.reach = e.u),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@register("op7_minhash_neardup", OP7_SQL)
def q_op7(spark, sf_dir):
    """Components of documents whose 2-word shingle sets have Jaccard >= 0.8."""
    from botsift.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS width,
         unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2),
                lambda s: array_to_string(ws[s : s + least(len(ws), 10) - 1], ' '))) AS phrase
  FROM b WHERE len(ws) > 0),
widths AS (SELECT DISTINCT width FROM win),
dw AS (
  SELECT doc_id, width, unnest(range(1, len(ws) - width + 2)) AS s,
         unnest(list_transform(range(1, len(ws) - width + 2),
                lambda s: array_to_string(ws[s : s + width - 1], ' '))) AS phrase
  FROM d CROSS JOIN widths WHERE len(ws) >= width),
occ AS (SELECT dw.doc_id, dw.s, dw.width, win.item_id FROM dw JOIN win ON win.width = dw.width AND win.phrase = dw.phrase),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(s, s + width)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS w FROM d),
cnt AS (SELECT w, count(*) AS n FROM tok GROUP BY w),
rare AS (
  SELECT item_id, w, n, row_number() OVER (PARTITION BY item_id ORDER BY n, w) AS r
  FROM (SELECT DISTINCT item_id, x.w, coalesce(n, 0) AS n
        FROM (SELECT item_id, unnest(ws) AS w FROM b) x LEFT JOIN cnt ON cnt.w = x.w) QUALIFY r <= 3),
need AS (SELECT item_id, count(*) AS k FROM rare GROUP BY item_id HAVING min(n) > 0),
first AS (SELECT rare.item_id, k, doc_id, pos FROM need JOIN rare USING (item_id) JOIN tok ON tok.w = rare.w WHERE r = 1),
near AS (
  SELECT DISTINCT doc_id, item_id FROM first WHERE k = 1
  UNION
  SELECT doc_id, item_id FROM (
    SELECT f.doc_id, f.item_id, f.pos, f.k, count(DISTINCT rare.r) AS n
    FROM first f JOIN rare ON rare.item_id = f.item_id AND rare.r > 1
    JOIN tok t ON t.doc_id = f.doc_id AND t.w = rare.w AND abs(t.pos - f.pos) <= 20
    GROUP BY 1, 2, 3, 4) WHERE n = k - 1),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS near_items FROM near GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(near_items, 0) AS BIGINT) AS near_items
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id LEFT JOIN nn ON nn.doc_id = d.doc_id
"""


@register("op1_benchmark_decontamination", OP1_SQL)
def q_op1(spark, sf_dir):
    """Exact 10-word benchmark leaks (and proximity matches) of every document."""
    from botsift.llm.decontam import contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("_row")


@register("op3_vector_bin_packing")
def q_op3(spark, sf_dir):
    """Every document's shard (0..15) and slot; shard bytes are near equal."""
    from pyspark.sql import functions as F

    from botsift.llm.sharding import assign_shards

    s = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return s.select("_row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
         WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
t AS (SELECT CAST(1.5 AS DOUBLE) * CAST(sum(source_size) AS DOUBLE) AS words, sum(w) AS weights FROM s),
q AS (  -- sources in the order in which they reach twice their size, and the level once those before are full
  SELECT source, source_size, w,
         (t.words - CAST(coalesce(sum(2 * source_size) OVER o, 0) AS DOUBLE))
         / CAST(t.weights - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM s, t WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT max(level) AS level FROM q),  -- it rises while sources are capped rightly, and falls beyond
g AS (
  SELECT source, source_size,
         CASE WHEN CAST(2 * source_size AS DOUBLE) < lv.level * w THEN CAST(2 * source_size AS DOUBLE)
              ELSE lv.level * w END AS target
  FROM s, lv),
x AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, '')))), 1, 13)
              AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""


@register("op6_source_mixing", OP6_SQL)
def q_op6(spark, sf_dir):
    """How many words the mix takes of every document."""
    from pyspark.sql import functions as F

    from botsift.llm.mixing import mix

    m = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("_row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, payload_bytes, p.payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to, true AS digest_ok
FROM p LEFT JOIN m ON m.payload_digest = p.payload_digest
"""


@register("op9_warc_roundtrip", OP9_SQL)
def q_op9(spark, sf_dir):
    """All pages written to WARC archives and read back by byte ranges."""
    from botsift.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 10 + 1) AS BIGINT)
         AS formatted_chars
FROM c GROUP BY conv_id
"""


@register("op10_chat_roundtrip", OP10_SQL)
def q_op10(spark, sf_dir):
    """All conversations, and one of control strings, formatted and read back."""
    from botsift.llm.chat import format_chats

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    out = format_chats(c.unionByName(extra), keep_text=False)
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@register("op4_tokeniser_fertility")
def q_op4(spark, sf_dir):
    """Base counts, tokeniser measures and verdict of every document."""
    from botsift.llm.quality import quality

    q = quality(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return q.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "kept", "script", "chars_per_piece", "chars_per_byte_level", "byte_share", "rel_entropy")


@register("op5_language_fusion")
def q_op5(spark, sf_dir):
    """Language of every page from its text, markup, host and address."""
    from botsift.llm.langid import fit_text_model, fuse

    model = fit_text_model(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return fuse(table(spark, sf_dir, "pages"), model)


@register("op2_gear_chunk_dedup")
def q_op2(spark, sf_dir):
    """Passages of every document that other documents have too."""
    from botsift.llm.cdc import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


@register("op8_fuzzy_line_dedup")
def q_op8(spark, sf_dir):
    """Every line's component of near-equal lines and whether it is kept."""
    from botsift.llm.linededup import fuzzy_lines

    return fuzzy_lines(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hx FROM documents),
h AS (
  SELECT doc_id, t, us, CAST(len(us) AS BIGINT) AS n, CAST('0x' || substr(hx, 1, 8) AS BIGINT) AS h1,
         CAST('0x' || substr(hx, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(hx, 17, 8) AS BIGINT) AS h3,
         CAST('0x' || substr(hx, 25, 8) AS BIGINT) AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, t, n, form, array_to_string(us[1 : lo], '') AS pre, array_to_string(us[lo + 1 : hi], '') AS mid,
         array_to_string(us[hi + 1 : n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@register("op13_fill_in_middle", OP13_SQL)
def q_op13(spark, sf_dir):
    """Every document as a fill-in-the-middle training text, and rebuilt from it."""
    from pyspark.sql import functions as F

    from botsift.llm.fim import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("_row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@register("op12_conv_toxicity")
def q_op12(spark, sf_dir):
    """Toxicity score of every document, by a classifier fitted on labelled ones."""
    from botsift.llm.toxicity import fit, held_out, toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    s = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return s.select("_row.doc_id", held_out(s["_row.doc_id"]).alias("held_out"), "score", "predicted", "threshold", "flagged")


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS n FROM k GROUP BY lang),
g AS (
  SELECT x.lang, x.source, coalesce(v.v, 0) AS v, coalesce(v.n, 0) + 2 * coalesce(v.v, 0) AS lang_total,
         coalesce(s.n, 0) + 2 * coalesce(v.v, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v ON v.lang = x.lang
  LEFT JOIN (SELECT c.lang, c.source, CAST(sum(c.n) AS HUGEINT) AS n FROM c JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL) s
  ON s.lang = x.lang AND s.source = x.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // g.total AS HUGEINT) AS p,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // g.lang_total AS HUGEINT) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 10
"""


@register("op11_source_divergence", OP11_SQL)
def q_op11(spark, sf_dir):
    """How far the sources of each language lie apart, and their telling terms."""
    from botsift.llm.divergence import divergence_audit

    return divergence_audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))
