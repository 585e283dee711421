"""The operators bound to the given tables, one query each, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.chat_trees import conversation_texts, conversations, digests, linear_replies
from corpuslens.llm.common import table
from corpuslens.llm.exact_dedup import exact_dedup
from corpuslens.llm.hard_negatives import hard_negatives
from corpuslens.llm.mixing import placed
from corpuslens.llm.packing import pack_documents, piece_digests
from corpuslens.llm.pii import KINDS, find_pii, joined_spans
from corpuslens.llm.secrets import BASE_RULES, MORE_RULES, scan
from corpuslens.llm.simhash import groups
from corpuslens.llm.token_counts import count_tokens
from corpuslens.llm.toxicity import held_out, toxicity
from corpuslens.llm.turn_repair import damaged, repair_digests, with_ids
from corpuslens.llm.url_filter import judge
from corpuslens.llm.vector_lsh import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@query("op1_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             sha256(t) AS text_sha256 FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return exact_dedup(table(spark, sf_dir, "documents"), carry=False)


@query("op2_mix", r"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][r % 3 + 1] AS w, 2 * s AS cap, 1.5 * sum(s) OVER () AS goal FROM s),
l AS (SELECT a.r, a.w, a.cap,
             (a.goal - coalesce(sum(b.cap), 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(b.w), 0)) AS level
      FROM w a LEFT JOIN w b ON b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.r < a.r)
      GROUP BY a.r, a.w, a.cap, a.goal),
t AS (SELECT w.source, w.s, least(w.cap, (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, r LIMIT 1) * w.w) AS target FROM w),
p AS (SELECT d.*, t.s, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target,
       CAST(least(greatest(round(target) - pos, 0), size) + least(greatest(round(target) - s - pos, 0), size) AS BIGINT) AS taken
FROM p
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, in order of its first training position."""
    rows = placed(table(spark, sf_dir, "documents"))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["words"])
    out = rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"),
                      F.get("uses", F.lit(0))["position"].alias("at"), "key")
    return (out.repartitionByRange("at", "key").sortWithinPartitions("at", "key")
            .select("doc_id", "size", "source_size", "target", "taken"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labelled rows that aren't held out."""
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: (host, path start, verdict), the rules of the URL filter's contract.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the model that learns from the ruled URLs."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_vector_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Tokenizer of the packing query; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(TOKENIZER))


def _formatted_sql() -> str:
    """Length of a formatted turn, told with replacements alone."""
    t = "coalesce(text, '')"
    marks = ("[INST]", "[/INST]", "<s>", "</s>", "<<ROLE:", "<</ROLE>>")
    extra = " + ".join([f"(len({t}) - len(replace({t}, chr(92), '')))"] +
                       [f"(len({t}) - len(replace({t}, '{m}', ''))) // {len(m)}" for m in marks])
    return f"len({t}) + {extra} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 8 ELSE 20 + len(role) END"


@query("op6_chat_trees", f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN len(coalesce(text, '')) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_formatted_sql()}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a reply tree of one branch, formatted, and what reading the output back gives."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    told = told.unionByName(spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], told.schema))
    replies = linear_replies(told, "conv_id", "turn", "role", "text")
    out = digests(conversation_texts(conversations(replies)))
    return out.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    out = find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("found").alias("spans"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the packed documents."""
    return piece_digests(pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    rows = scan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    kinds = [r.kind for r in BASE_RULES + MORE_RULES]
    order = F.array(*[F.lit(k) for k in kinds])
    by_start = F.array_sort(F.transform("secrets", lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["kind"].alias("kind"), s["end"].alias("end"))))
    rows = rows.withColumn("secrets", by_start)
    base = [r.kind for r in BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, base), F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
                       joined(F.col("secrets")).alias("spans"))


@query("op11_hard_negatives", r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id AS vec_id, a.label = b.label AS same,
             CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor's positives with their hard negatives; some labels are moved on first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op13_turn_repair", r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (
  SELECT said.*, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT),
           lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 20 AS h FROM said, crc),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM rows_),
told AS (
  SELECT *, left(role, 1) AS i, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                                     WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM seen),
v AS (
  SELECT conv_id, count(*) + 1 AS n, {'c': 0, 'p': '', 't': []::VARCHAR[]} AS e, {'c': 6, 'p': 'II', 't': ['user:', 'assistant:']} AS s,
         {'c': 3, 'p': 'I', 't': ['assistant:']} AS u, {'c': 0, 'p': '', 't': []::VARCHAR[]} AS a FROM told GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n, least(we, {'c': 3 + vu.c, 'p': 'I' || vu.p, 't': ['user:'] || vu.t}), least(ws, {'c': 3 + vu.c, 'p': 'I' || vu.p, 't': ['user:'] || vu.t}),
         vu, least(wa, {'c': 3 + wu.c, 'p': 'I' || wu.p, 't': ['user:'] || wu.t})
  FROM (SELECT *, least(wu, {'c': 3 + wa.c, 'p': 'I' || wa.p, 't': ['assistant:'] || wa.t}) AS vu
        FROM (SELECT conv_id, n,
                     least({'c': 4 + e.c, 'p': 'D' || e.p, 't': e.t}, CASE WHEN ok AND i = 's' THEN ks WHEN ok AND i = 'u' THEN ku END, CASE WHEN ok THEN ru END) AS we,
                     least({'c': 4 + s.c, 'p': 'D' || s.p, 't': s.t}, CASE WHEN ok AND i = 'u' THEN ku END, CASE WHEN ok THEN ru END) AS ws,
                     least({'c': 4 + u.c, 'p': 'D' || u.p, 't': u.t}, CASE WHEN ok AND i = 'a' THEN ka END, CASE WHEN ok THEN ra END) AS wu,
                     least({'c': 4 + a.c, 'p': 'D' || a.p, 't': a.t}, CASE WHEN ok AND i = 'u' THEN ku END, CASE WHEN ok THEN ru END) AS wa
              FROM (SELECT r.conv_id, r.n, r.i, e, s, u, a, r.fault NOT IN ('blank', 'duplicate') AS ok,
                           {'c': x.s.c + cut, 'p': 'K' || x.s.p, 't': [line] || x.s.t} AS ks, {'c': x.u.c + cut, 'p': 'K' || x.u.p, 't': [line] || x.u.t} AS ku,
                           {'c': x.a.c + cut, 'p': 'K' || x.a.p, 't': [line] || x.a.t} AS ka,
                           {'c': 3 + x.u.c + cut, 'p': 'R' || x.u.p, 't': ['user:' || r.text] || x.u.t} AS ru,
                           {'c': 3 + x.a.c + cut, 'p': 'R' || x.a.p, 't': ['assistant:' || r.text] || x.a.t} AS ra
                    FROM v x JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS cut, role || ':' || text AS line FROM told) r
                         ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.n = x.n - 1)))),
f AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
         count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v.e.c, 0) AS BIGINT) AS cost,
       coalesce(v.e.p, '') AS audit, sha256(coalesce(array_to_string(v.e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
     LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM o.conv_id AND v.n = 1
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = with_ids(told.select("conv_id").distinct(), repair_digests(damaged(told)), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
