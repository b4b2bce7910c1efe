"""Registered queries of the curation operators over whole tables, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys, replies
from ..functions import text as X
from ..operators import chunking, dedup, gates, grounding, split
from ..sinks import exports
from ..sources import pages as html
from . import demo

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Pieces of SQL. Documents of the test tables have no whitespace but blanks and line feeds.
NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' +\n', e'\n', 'g'), '\n{3,}', e'\n\n', 'g'), e' \n')"
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(replace({NORMAL}, e'\n', ' '), '([.!?])\s+([A-ZÀ-ÿ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def tokens_sql(column: str) -> str:
    return rf"list_filter(list_distinct(list_transform(list_filter(regexp_extract_all({column}, '[\p{{L}}\p{{N}}_À-ÿ]+'), lambda w: length(w) > 2), lambda w: lower(w))), lambda w: NOT list_contains({STOPS}, w))"


@query(f"SELECT doc_id, {NORMAL} AS text FROM documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, unnest(range(0, len(s)))::INT AS position, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.split_sentences(X.normalize(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(s).alias("position", "sentence"))


CHUNKS = f"""
WITH RECURSIVE cut AS (SELECT doc_id, {SENTENCES} AS s FROM documents),
sums AS (SELECT doc_id, s, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: length(x) + 1)), 0)) AS c FROM cut WHERE len(s) > 0),
chunks AS (
  SELECT doc_id, 0 AS n, 1 AS j, 1 AS f FROM sums
  UNION ALL
  SELECT doc_id, n + 1, coalesce(list_min(list_filter(range(j, e + 1), lambda k: c[e + 1] - c[k] <= 150)), e + 1), e + 1
  FROM (SELECT x.doc_id, n, j, f, s, c, greatest(f, list_max(list_filter(range(j, len(s) + 1), lambda i: c[i + 1] - c[j] <= 1200))) AS e FROM chunks x JOIN sums USING (doc_id))
  WHERE e < len(s)),
ends AS (SELECT x.doc_id, n, array_to_string(s[j:greatest(f, list_max(list_filter(range(j, len(s) + 1), lambda i: c[i + 1] - c[j] <= 1200)))], ' ') AS text FROM chunks x JOIN sums USING (doc_id))
SELECT printf('%s:%04d:%s', doc_id::VARCHAR, n, substr(sha1(text), 1, 10)) AS id, text, doc_id::VARCHAR AS source, n::INT AS index, length(text)::INT AS char_count FROM ends
"""


@query(CHUNKS)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chunking.chunk_text(table(spark, sf_dir, "documents"), "doc_id")
    return got.select("id", "text", "source", "index", F.col("metadata.char_count").alias("char_count"))


PAGE = "html"
for _tag in sorted(html.SKIP):
    PAGE = rf"regexp_replace({PAGE}, '(?is)<{_tag}\b[^>]*>.*?(</{_tag}\s*>|$)', e'\x01', 'g')"
PAGE = rf"regexp_replace(regexp_replace(regexp_replace({PAGE}, '(?s)<!--.*?-->', e'\x01', 'g'), '(?s)<[^>]*>', e'\x01', 'g'), '(?s)<[^>]*$', '', 'g')"
for _name, _char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    PAGE = f"regexp_replace({PAGE}, '&{_name};?', '{_char}', 'g')"
PAGE = rf"array_to_string(list_filter(list_transform(string_split({PAGE}, e'\x01'), lambda x: trim(x, e' \n\t')), lambda x: x <> ''), e'\n')"


@query(rf"SELECT page_id, trim(regexp_replace({PAGE}, '\n{{3,}}', e'\n\n', 'g'), e' \n') AS text FROM pages")
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_text(table(spark, sf_dir, "pages"), "page_id", "html")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn with the user's turn before it."""
    turns = table(spark, sf_dir, "conversations")
    before = W.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("asked", F.lag("text").over(before)).withColumn("asker", F.lag("role").over(before)).where("role = 'assistant' and asker = 'user'")


ANSWERS = "SELECT * FROM (SELECT *, lag(text) OVER w AS asked, lag(role) OVER w AS asker FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND asker = 'user'"


@query(f"SELECT doc_id, list_sort({tokens_sql('text')}) AS tokens FROM documents")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(X.content_tokens(F.col("text"))).alias("tokens"))


@query(f"SELECT conv_id, turn, len(list_intersect({tokens_sql('text')}, {tokens_sql('asked')}))::INT AS shared, len({tokens_sql('text')})::INT AS words FROM ({ANSWERS})")
def overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared, words = X.overlap_parts(F.col("text"), F.col("asked"))
    return answers(spark, sf_dir).select("conv_id", "turn", shared.alias("shared"), words.alias("words"))


@query(
    f"SELECT conv_id, turn, n > 0 AND m > 0 AND round_even(hit / n, 4) >= 0.1 AS grounded FROM (SELECT conv_id, turn, len(list_intersect({tokens_sql('text')}, {tokens_sql('asked')})) AS hit, len({tokens_sql('text')}) AS n, len({tokens_sql('asked')}) AS m FROM ({ANSWERS}))"
)
def grounded_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.ground(answers(spark, sf_dir), "conv_id", "text", "asked", min_token=0.1).select("conv_id", "turn", "grounded")


BAG = r"""
words AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower({text}), '\s+'), lambda w: w <> '')) AS w FROM documents),
hashed AS (SELECT doc_id, sha1(w) AS h FROM words),
bags AS (SELECT doc_id, ('0x' || h[1:2])::BIGINT AS bucket, sum(CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS n FROM hashed GROUP BY 1, 2 HAVING n <> 0)
"""


@query(f"WITH {BAG.format(text='text')} SELECT doc_id, bucket::INT AS bucket, n FROM bags")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup.hash_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.select("doc_id", F.explode(F.arrays_zip("buckets", "counts")).alias("x")).select("doc_id", F.col("x.buckets").alias("bucket"), F.col("x.counts").alias("n"))


#: Instructions: what users say in the conversations.
ASKED = "asked AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE role = 'user')"
PAIRS = f"""
{ASKED},
{BAG.replace("documents", "asked").format(text="text")},
norms AS (SELECT doc_id, sum(n * n) AS q FROM bags GROUP BY doc_id),
dots AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.n * b.n) AS dot FROM bags a JOIN bags b ON a.bucket = b.bucket AND a.doc_id < b.doc_id GROUP BY 1, 2),
edges AS (SELECT i, j FROM dots JOIN norms a ON a.doc_id = i JOIN norms b ON b.doc_id = j WHERE dot >= 0.6 * sqrt((a.q * b.q)::DOUBLE))
"""
GREEDY = """
late AS (SELECT j, list(i) AS before, row_number() OVER (ORDER BY j) AS r FROM edges GROUP BY j),
walk AS (
  SELECT 0::BIGINT AS r, []::BIGINT[] AS dropped
  UNION ALL
  SELECT late.r, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, j) ELSE dropped END FROM walk JOIN late ON late.r = walk.r + 1),
lost AS (SELECT unnest(dropped) AS id FROM (SELECT dropped FROM walk ORDER BY r DESC LIMIT 1))
"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "text")


@query(f"WITH {PAIRS} SELECT i AS early, j AS late FROM edges")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(dedup.hash_vectors(asked(spark, sf_dir), "at", "text"), 0.6, 256)


@query(f"WITH RECURSIVE {PAIRS}, {GREEDY} SELECT doc_id AS at, doc_id NOT IN (SELECT id FROM lost) AS accepted FROM asked")
def diversity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.diversity(asked(spark, sf_dir), "at", "text", 0.6).select("at", "accepted")


@query(
    f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS q FROM embeddings),
edges AS (SELECT a.id AS i, b.id AS j FROM v a JOIN v b ON a.id < b.id WHERE list_inner_product(a.e, b.e) >= 0.4 * sqrt(a.q * b.q)),
{GREEDY} SELECT vec_id, vec_id NOT IN (SELECT id FROM lost) AS accepted FROM embeddings"""
)
def vector_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.vector_diversity(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4).select("vec_id", "accepted")


@query(
    """WITH t AS (SELECT conv_id, count(*) AS n, bool_and(lower(trim(role)) = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AND trim(text) <> '') AS ok
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id) SELECT conv_id, ok AND n >= 2 AND n % 2 = 0 AS valid FROM t"""
)
def dialogue_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", replies.alternates(F.col("m")).alias("valid"))


@query(
    """WITH n AS (SELECT count(*) AS n FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents)
SELECT doc_id, CASE WHEN place < least(greatest(1, round_even(n * 0.1, 0)), n - 1) THEN 'eval' ELSE 'train' END AS part FROM o, n"""
)
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.train_eval_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY md5('1234:' || doc_id), doc_id) - 1)::BIGINT AS position FROM documents")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 1234)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as candidates: short ones count as near duplicates, toxic ones as not grounded, quality decides the score."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.withColumn("decision", gates.gate(F.col("n_chars") >= 100, F.col("toxic") == 0, F.col("quality") * 9, 7))


CANDIDATES = "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'diversity_rejected' WHEN toxic <> 0 THEN 'hallucination_rejected' WHEN quality * 9 < 7 THEN 'judge_rejected' ELSE 'kept' END AS decision FROM documents JOIN labels USING (doc_id)"
RUNNING = f"SELECT *, coalesce(sum((decision = 'kept')::INT) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM ({CANDIDATES})"


@query(f"SELECT doc_id, CASE WHEN had >= 200 THEN 'unexamined' ELSE decision END AS decision FROM ({RUNNING})")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.stop_at(candidates(spark, sf_dir), "doc_id", 200).select("doc_id", "decision")


@query(f"SELECT doc_id, CASE WHEN had >= 200 AND decision = 'kept' THEN 'overflow' ELSE decision END AS decision FROM ({RUNNING})")
def gate_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.stop_at(candidates(spark, sf_dir), "doc_id", 200, "reject").select("doc_id", "decision")


@query(
    f"""SELECT 0::BIGINT AS seeds, count(*) AS generated, count(*) FILTER (decision IN ('kept', 'judge_rejected')) AS judged, count(*) FILTER (decision = 'diversity_rejected') AS diversity_rejected,
count(*) FILTER (decision = 'hallucination_rejected') AS hallucination_rejected, count(*) FILTER (decision = 'judge_rejected') AS judge_rejected, count(*) FILTER (decision = 'kept') AS kept, 0::BIGINT AS dpo_pairs FROM ({CANDIDATES})"""
)
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.stats(candidates(spark, sf_dir))


@query(
    f"""SELECT 'about ' || doc_id AS instruction, text AS chosen, left(text, 40) AS rejected, (quality * 9)::INT AS chosen_score, (doc_id % 11)::INT AS rejected_score, [doc_id::VARCHAR] AS source_chunks
FROM documents JOIN labels USING (doc_id) WHERE trim(left(text, 40), e' \n') NOT IN ('', trim(text, e' \n')) AND doc_id % 11 < quality * 9"""
)
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return gates.preference_pairs(
        rows.select(
            F.concat(F.lit("about "), "doc_id").alias("instruction"), F.col("text").alias("output"), F.substring("text", 1, 40).alias("weak"), (F.col("quality") * 9).cast("int").alias("judge_score"),
            (F.col("doc_id") % 11).cast("int").alias("weak_score"), F.array(F.col("doc_id").cast("string")).alias("source_chunks"),
        )
    )


SYNTHETIC = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Sure: {"score": ' || (doc_id % 14) || ', "reason": " because ' || doc_id || ' "} done' WHEN 1 THEN '{"score": "' || (doc_id % 9) || '.5"}'
WHEN 2 THEN 'no verdict' WHEN 3 THEN '[note] {"score": 3}' WHEN 4 THEN '{"score": null, "reason": null}' ELSE '{"score": true, "reason": 12}' END AS raw FROM documents"""


@query(
    rf"""WITH r AS ({SYNTHETIC}), p AS (SELECT doc_id, CASE WHEN doc_id % 6 IN (2, 3) THEN NULL ELSE regexp_extract(raw, '\{{.*\}}') END AS j FROM r)
SELECT doc_id, coalesce(greatest(0, least(10, round_even(coalesce(CASE WHEN j ->> '$.score' = 'true' THEN 1 ELSE try_cast(j ->> '$.score' AS DOUBLE) END, 0), 0)))::INT, 0) AS score,
CASE WHEN j IS NULL THEN 'unparseable judge response' WHEN NOT json_exists(j, '$.reason') THEN '' ELSE trim(coalesce(j ->> '$.reason', 'None')) END AS reason FROM p"""
)
def parse_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(SYNTHETIC).select("doc_id", replies.verdict(F.col("raw")).alias("v")).select("doc_id", "v.score", "v.reason")


SEED_REPLIES = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Here: ["Explain item ' || doc_id || '", "short", " Why is ' || doc_id || ' here? "]'
WHEN 1 THEN '[{"question": "What is ' || doc_id || '?"}, {"instruction": "", "prompt": "Describe ' || doc_id || ' now"}, {"other": "nothing here"}, 12345678]' WHEN 2 THEN '{"a": 1}' ELSE 'none' END AS raw FROM documents"""


@query(
    """SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN [0, 1] ELSE [0, 1] END)::INT AS seed_pos,
unnest(CASE doc_id % 4 WHEN 0 THEN ['Explain item ' || doc_id, 'Why is ' || doc_id || ' here?'] ELSE ['What is ' || doc_id || '?', 'Describe ' || doc_id || ' now'] END) AS instruction FROM documents WHERE doc_id % 4 < 2"""
)
def parse_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(SEED_REPLIES).select("doc_id", F.posexplode(replies.seeds(F.col("raw"))).alias("seed_pos", "instruction"))


REWRITES = """SELECT doc_id, 'Explain document ' || doc_id AS original, CASE doc_id % 5 WHEN 0 THEN 'Rewritten: "Explain document ' || doc_id || ' in depth"' WHEN 1 THEN 'explain DOCUMENT ' || doc_id
WHEN 2 THEN 'no' WHEN 3 THEN ' instruction: Compare document ' || doc_id || ' ' ELSE repeat('x', 801) END AS raw FROM documents"""


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Explain document ' || doc_id || ' in depth' WHEN 3 THEN 'Compare document ' || doc_id END AS instruction FROM documents")
def clean_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(REWRITES).select("doc_id", replies.evolution(F.col("raw"), F.col("original")).alias("instruction"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer of the conversations as an example."""
    return answers(spark, sf_dir).select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("asked").alias("instruction"), F.col("text").alias("output"), F.array(F.col("conv_id").cast("string")).alias("source_chunks"),
        F.when(F.col("conv_id") % 2 == 0, F.lit(8)).alias("judge_score"), F.when(F.col("conv_id") % 3 == 0, F.to_variant_object(F.struct(F.struct(F.lit("look_up").alias("name"), F.struct(F.col("conv_id").alias("of")).alias("arguments")).alias("tool_call")))).alias("metadata"),
    )


@query(
    f"SELECT conv_id || ':' || turn AS id, unnest(['system', 'user', 'assistant']) AS role, unnest(['{exports.SYSTEM_PROMPT}', asked, text]) AS content FROM ({ANSWERS})"
)
def export_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = examples(spark, sf_dir).select("id", F.explode(exports.chat_messages()).alias("m"))
    return got.select("id", "m.role", "m.content")


@query(f"SELECT asked AS instruction, text AS output FROM ({ANSWERS})")
def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.flat(examples(spark, sf_dir))


@query(f"SELECT asked AS instruction, text AS output, [conv_id::VARCHAR] AS source_chunks, CASE WHEN conv_id % 2 = 0 THEN 8 ELSE -1 END AS judge_score FROM ({ANSWERS})")
def export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.dataset_columns(examples(spark, sf_dir))


@query(f"SELECT asked AS instruction, text AS output, 'look_up' AS name, '{{\"of\":' || conv_id || '}}' AS arguments FROM ({ANSWERS}) WHERE conv_id % 3 = 0")
def export_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exports.tool_calls(examples(spark, sf_dir))
    return got.select(
        F.col("messages")[1].content.alias("instruction"), F.col("messages")[3].content.alias("output"), F.col("messages")[3]["name"].alias("name"), F.col("messages")[2].tool_calls[0].function.arguments.alias("arguments")
    )


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS response, doc_id % 2 = 0 AS hit FROM documents")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = keys.cache_key(F.lit("stub"), F.lit(0.0), F.lit(200), F.lit(None).cast("string"), F.concat_ws(":", "doc_id", "text"))
    stored = docs.where("doc_id % 2 = 0").select(key.alias("key"), F.col("n_chars").alias("response"))
    return docs.withColumn("key", key).join(stored, "key", "left").select("doc_id", "response", F.col("response").isNotNull().alias("hit"))


@query("SELECT sha256('stub|0.7000|200||' || text) AS key, doc_id FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = keys.cache_key(F.lit("stub"), F.lit(0.70000), F.lit(200), F.lit(None).cast("string"), F.col("text"))
    return table(spark, sf_dir, "documents").select(key.alias("key"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT event_id, event_type AS status, user_id FROM events WHERE event_type IN ('click', 'view') ORDER BY ts DESC, event_id LIMIT 50")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).orderBy(F.desc("ts"), "event_id").limit(50)
    return newest.select("event_id", F.col("event_type").alias("status"), "user_id")


@query(
    """SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'n<1K' WHEN n_chars < 10000 THEN '1K<n<10K' WHEN n_chars < 100000 THEN '10K<n<100K' WHEN n_chars < 1000000 THEN '100K<n<1M' ELSE 'n>1M' END AS bucket,
CASE lang WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' ELSE 'en' END AS code FROM documents"""
)
def size_and_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("lang") == "fr", " French ").when(F.col("lang") == "de", "German").when(F.col("lang") == "es", "SPANISH").otherwise("klingon")
    return table(spark, sf_dir, "documents").select("doc_id", keys.size_bucket(F.col("n_chars")).alias("bucket"), keys.language_code(names).alias("code"))


@query("SELECT sha1(string_agg(doc_id || '|', '' ORDER BY doc_id::VARCHAR)) AS ids_hash, count(*) AS n FROM documents")
def run_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return spark.createDataFrame([(keys.ids_hash(docs, "id"), docs.count())], "ids_hash string, n bigint")


@query("SELECT doc_id, sha1(lower('About ' || doc_id) || '|' || lower(trim(text, e' \\n'))) AS key FROM documents")
def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", keys.pair_key(F.concat(F.lit(" About "), "doc_id"), F.col("text")).alias("key"))


@query()
def stub_pipeline_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole generation run over all documents with a deterministic stub model: kept and rejected examples with their decisions."""
    return demo.end_to_end(spark, table(spark, sf_dir, "documents"))


@query()
def stub_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.dialogues(spark, table(spark, sf_dir, "documents"))
