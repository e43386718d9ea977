"""The operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, decontam, fim, fingerprints, kneser, language, licenses, linedup, mixing, pages, secrets, simhash, turns
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


@query(
    "op2_decontaminate",
    r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
cand AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
         FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows))),
hits AS (SELECT c.doc_id, c.i, c.size, x.item_id FROM cand c JOIN windows x ON c.win = x.win AND c.size = x.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list(id ORDER BY id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id),
spans AS (SELECT doc_id, 1 AS x FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
)
def op2(spark, sf):
    found = decontam.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("items", "spans")


@query("op6_simhash_near_dedup")
def op6(spark, sf):
    return simhash.near_groups(table(spark, sf, "documents"))


MIX_SQL = """
sized AS (SELECT doc_id, source, CAST({size} AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0') AS draw FROM {docs}),
per AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, 2 * source_size AS lim FROM per),
o AS (SELECT *, lim / w AS ratio, sum(source_size) OVER () AS total,
             coalesce(sum(lim) OVER (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
             sum(w) OVER (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
l AS (SELECT *, (1.5::DOUBLE * total - ahead) / weights AS level FROM o),
f AS (SELECT first(level ORDER BY ratio, source IS NULL, source) AS water FROM l WHERE level * w <= lim),
goal AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(CAST(lim AS DOUBLE), coalesce(water * w, CAST(lim AS DOUBLE))) AS target FROM l LEFT JOIN f ON true),
run AS (SELECT s.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS words,
               coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
        FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
mixed AS (SELECT doc_id, source, size, source_size, target,
          CAST(CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size
               + greatest(0, least(words - (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END) * source_size - ahead, size)) AS BIGINT) AS taken FROM run)"""
SIZE_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


@query("op10_mix_sources", "WITH " + MIX_SQL.format(size=SIZE_SQL, docs="documents") + " SELECT doc_id, size, source_size, target, taken, source FROM mixed")
def op10(spark, sf):
    return mixing.report(table(spark, sf, "documents"))


@query("op8_quality_perplexity")
def op8(spark, sf):
    return kneser.report(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op1_multiset_fingerprints")
def op1(spark, sf):
    return fingerprints.report(table(spark, sf, "documents"))


@query(
    "op5_chat_format",
    r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '~', '~~'), '(<)(/?s>|</?SYS>>|</?ROLE>>|<TEXT>>)', '\1~\2', 'g'), '(\[)(/?INST\])', '\1~\2', 'g') AS inside FROM t),
f AS (SELECT *, CASE role WHEN 'user' THEN '[INST] ' || inside || ' [/INST]' WHEN 'assistant' THEN ' ' || inside || '</s>'
                WHEN 'system' THEN '<<SYS>>' || chr(10) || inside || chr(10) || '<</SYS>>'
                ELSE '<<ROLE>>' || role || '<<TEXT>>' || inside || '<</ROLE>>' END AS formatted FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, formatted)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, formatted), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
)
def op5(spark, sf):
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(turns.unionByName(more))


@query("op7_line_dedup")
def op7(spark, sf):
    return linedup.report(table(spark, sf, "documents"))


@query("op9_language_profiles")
def op9(spark, sf):
    return language.report(table(spark, sf, "documents"))


@query("op3_secret_scan")
def op3(spark, sf):
    return secrets.scan(table(spark, sf, "documents"))


@query("op4_main_text")
def op4(spark, sf):
    return pages.report(table(spark, sf, "pages"))


@query(
    "op11_fill_in_middle",
    r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
h AS (SELECT *, len(w) AS n, CAST('0x' || draw[1:8] AS BIGINT) AS h1, CAST('0x' || draw[9:16] AS BIGINT) AS h2,
             CAST('0x' || draw[17:24] AS BIGINT) AS h3, CAST('0x' || draw[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(w[1:i], ''), '') AS head, coalesce(array_to_string(w[i + 1:j], ''), '') AS middle,
             coalesce(array_to_string(w[j + 1:n], ''), '') AS tail FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle
              ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
)
def op11(spark, sf):
    return fim.report(table(spark, sf, "documents"))


def _notices_sql() -> str:
    rows = [f"('{n.label}', '{n.family}', {n.stride}, {n.need}, [{', '.join(repr(w) for w in n.words)}])" for n in licenses.notices_of(licenses.NOTICES, licenses.THRESHOLD)]
    return f"notices(label, family, stride, need, own) AS (VALUES {', '.join(rows)})"


@query(
    "op12_license_scan",
    r"""
WITH """
    + _notices_sql()
    + r""",
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bases(label, own) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
hits AS (SELECT doc_id, label, i FROM (SELECT doc_id, label, w, own, unnest(range(0, len(w) - len(own) + 1)) AS i FROM d, bases) WHERE w[i + 1 : i + len(own)] = own),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id),
blocks AS (SELECT doc_id, stride, b, w[b * stride + 1 : b * stride + 2 * stride] AS words
           FROM (SELECT doc_id, w, stride, unnest(range(0, (len(w) + stride - 1) // stride)) AS b FROM d, (SELECT DISTINCT stride FROM notices))),
met AS (SELECT doc_id, family, label, s.stride, b, len(own) AS size, len(list_filter(own, lambda x: list_contains(words, x))) AS shared
        FROM blocks s JOIN notices n ON s.stride = n.stride WHERE len(list_filter(own, lambda x: list_contains(words, x))) >= need),
best AS (SELECT *, rank() OVER (PARTITION BY doc_id, family, stride, b ORDER BY shared / size DESC, shared DESC) AS place FROM met),
own AS (SELECT doc_id, list(DISTINCT label) AS labels, max(shared / size) AS score FROM best WHERE place = 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(own.score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)""",
)
def op12(spark, sf):
    return licenses.report(table(spark, sf, "documents"))


@query("op13_turn_repair")
def op13(spark, sf):
    return turns.report(table(spark, sf, "conversations"))
