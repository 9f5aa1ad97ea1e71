"""The registered queries of this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normatile.llm import centroids, chat, decontaminate, filter_audit, line_dedup, mixing, near_dedup, pii, quality, substring_dedup, suffix_dedup, token_files, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_table(spark, sf, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256))


@query("op10_token_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    out = tokens.count_tokens(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op9_source_mix")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP3_SQL = """
WITH t AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, i, lines[i + 1] AS line, len(lines) AS n, ('0x' || substr(md5(lines[i + 1]), 1, 14))::BIGINT AS h
  FROM t, unnest(range(0, len(lines))) AS u(i)
),
r AS (SELECT *, xor(h, coalesce(lag(h) OVER w, 0) << 1) % 3 = 0 AS ends FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, ends AND NOT coalesce(lag(ends) OVER w, false) AND i < n - 1 AS cut FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece
  FROM c
),
m AS (SELECT *, (i - min(i) OVER (PARTITION BY doc_id, piece)) // 32 AS part FROM k),
chunks AS (
  SELECT doc_id, min(i) AS s, max(i) AS e, string_agg(line, chr(10) ORDER BY i) AS chunk FROM m GROUP BY doc_id, piece, part HAVING count(*) >= 3
  UNION ALL
  SELECT doc_id, i, i + 1, line || chr(10) || next FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l) WHERE i < n - 1
),
again AS (
  SELECT doc_id, s, e FROM chunks WHERE length(chunk) >= 32 QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, s) > 1
),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i FROM again, unnest(range(s, e + 1)) AS u(i)),
sums AS (
  SELECT doc_id, count(*) AS n_removed_lines, count(*) FILTER (opens) AS n_removed_runs
  FROM (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 1, true) AS opens FROM gone) GROUP BY doc_id
),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
o AS (
  SELECT t.doc_id, len(t.lines) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines,
    coalesce(n_removed_runs, 0) AS n_removed_runs, CASE WHEN t.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
  FROM t LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
)
SELECT *, sha256(coalesce(text, '')) AS kept_sha256 FROM o
"""


@query("op3_line_dedup", OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf, "documents"))
    return out.select(
        "row.doc_id", "n_lines", "n_removed_lines", "n_removed_runs", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def _escaped(text: str) -> str:
    sql = f"replace({text}, '\\', '\\b')"
    for c in chat.CONTROL:
        sql = f"replace({sql}, '{c}', '{chat._ESCAPES[c[0]]}{c[1:]}')"
    return sql


OP4_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op4_chat_formatting", OP4_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    talks = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0), F.lit("user")), F.struct(F.lit(1), F.lit("assistant")))).alias("r")
    )
    added = added.select("conv_id", F.col("r.col1").cast("long").alias("turn"), F.col("r.col2").alias("role"), F.lit(probe).alias("text"))
    records = chat.records_of_turns(talks.unionByName(added), "conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(records))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
  FROM i, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(p) WHERE len(w) > 0
),
ks AS MATERIALIZED (SELECT DISTINCT k FROM iw),
dk AS (SELECT doc_id, k, w FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM dk, unnest(range(1, len(w) - k + 2)) AS u(p)),
hit AS MATERIALIZED (SELECT DISTINCT doc_id, p, k, item_id FROM dw JOIN iw USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + k)) AS u(q) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op5_benchmark_decontamination", OP5_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    out = decontaminate.verdict(found)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op7_quality_rules")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return quality.judge(docs, quality.learn_rules(docs, _table(spark, sf, "labels")))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(p) WHERE len(w) > 0
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 80 * (na.n + nb.n - common)
),
reach AS (
  WITH RECURSIVE r(x, y) AS (
    SELECT doc_id, doc_id FROM d
    UNION
    SELECT r.x, e.v FROM r JOIN (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links) e ON r.y = e.u
  )
  SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op8_minhash_near_dedup", OP8_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf, "documents"), width=4, percent=80)


@query("op6_personal_data")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_personal(_table(spark, sf, "documents"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    added = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in ("secret", "number", "contact")]
    joined = [F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans")]
    return found.select("doc_id", *counts, *joined, *added)


def _is(kind: str):
    return lambda x: x["kind"] == kind


OP2_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS g FROM b, unnest(range(0, length(h) // 2 - 99)) AS u(p)),
again AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
marked AS (SELECT *, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, -1) AS opens FROM again),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS s, max(p) + 100 AS e FROM numbered GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, e AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS z FROM spans
  UNION ALL SELECT b.doc_id, 0, (SELECT min(s) FROM spans WHERE spans.doc_id = b.doc_id) FROM b
),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, length(h) // 2) - a)), '' ORDER BY a) AS k FROM gaps JOIN b USING (doc_id) GROUP BY doc_id
),
sums AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


@query("op2_suffix_dedup", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_token_files")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    path = token_files.write_tokens(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    near = """SELECT v.r, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, j := c.j)) AS m
  FROM v, c{t} c GROUP BY v.r"""
    sql = f"""
WITH e AS (SELECT vec_id, row_number() OVER () AS r, embedding AS f FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (
  SELECT vec_id, r, list_transform(f, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS x FROM e
  WHERE len(list_filter(f, lambda y: y IS NOT NULL AND isfinite(y))) = 64
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS j, x FROM v ORDER BY sha256('3:' || vec_id), x LIMIT {k}
)"""
    for t in range(rounds):
        sql += f""",
a{t} AS MATERIALIZED ({near.format(t=t)}),
s{t} AS (SELECT m.j AS j, p, sum(x[p]) AS s, count(*) AS n FROM a{t} JOIN v USING (r), unnest(range(1, 65)) AS u(p) GROUP BY ALL),
m{t} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS x FROM s{t} GROUP BY j),
c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m ON c.j = m.j)"""
    return sql + f""",
last AS MATERIALIZED ({near.format(t=rounds)})
SELECT vec_id, m.j::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM last JOIN v USING (r) JOIN c{rounds} c ON c.j = m.j
"""


@query("op12_centroid_clusters", _op12_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.described(*centroids.cluster(_table(spark, sf, "embeddings")))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents
),
f AS MATERIALIZED (
  SELECT doc_id, part, (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
    (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT AS c, regexp_matches(text, '[#$%&*|]')::INT AS d,
    (coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false))::INT AS e FROM t
),
g AS MATERIALIZED (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM f GROUP BY ALL
),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (
  SELECT x1.l || x2.l || x3.l || x4.l || x5.l AS filter_order FROM x x1, x x2, x x3, x x4, x x5
  WHERE len(list_distinct([x1.l, x2.l, x3.l, x4.l, x5.l])) = 5
),
st AS (
  SELECT filter_order, s AS step, 1 << (ord(filter_order[s]) - 65) AS bit,
    list_sum(list_transform(range(1, s), lambda q: 1 << (ord(filter_order[q]) - 65))) AS before FROM o, unnest(range(1, 6)) AS u(s)
),
z AS (
  SELECT part, filter_order, step::INT AS step, bit,
    coalesce(sum(n) FILTER (mask & (bit | coalesce(before, 0)::INT) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INT <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0), 0)::BIGINT AS toxic_lost
  FROM g, st GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM z
"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    labels = _table(spark, sf, "labels")
    lost = {"good_lost": labels.where("quality = 1").select("doc_id"), "toxic_lost": labels.where("toxic = 1").select("doc_id")}
    return filter_audit.audit_filters(
        _table(spark, sf, "documents"), filter_audit.text_filters(F.col("text")), lost, copies="E", part=F.col("lang")
    )
