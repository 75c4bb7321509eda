"""Text functions over documents and benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans, text as T
from ..operators import batching
from ..operators.quotes import quote_places
from .registry import query, table


@query(
    """SELECT item_id, sha1(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))[:20] AS digest,
  'b:t:' || sha1(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))[:20] AS key FROM benchmark"""
)
def sha1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content keys of requirement texts."""
    normal = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f\x0B]+", " "))
    none = F.lit(None).cast("int")
    key = T.requirement_key(F.lit("b"), none, none, normal)
    return table(spark, sf_dir, "benchmark").select("item_id", F.substring(key, 5, 20).alias("digest"), key.alias("key"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS INTEGER) AS words, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12, X21."""
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'must' WHEN 'PROMO' THEN 'should' WHEN 'STANDARD' THEN 'could' END AS priority FROM part"""
)
def priority_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buyer's wording to must, should, could."""
    said = F.when(F.col("p_type") == "ECONOMY", " It MUST  hold. ").when(F.col("p_type") == "PROMO", "Desirable").when(F.col("p_type") == "STANDARD", "a nice to have.").otherwise("-")
    return table(spark, sf_dir, "part").select("p_partkey", T.priority(said).alias("priority"))


@query("SELECT c_custkey, 'Describe ' || c_name AS text FROM customer")
def strip_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading question numbers dropped."""
    said = F.concat(F.lit(" Question "), F.col("c_custkey").cast("string"), F.lit(".2) Describe "), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.strip_leading_number(said).alias("text"))


@query(
    """WITH a AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark)
SELECT x.item_id, levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) AS share FROM a x JOIN a y ON y.item_id = x.item_id + 1"""
)
def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised edit distance of neighbouring texts (ASCII-folded)."""
    a = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("t"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return a.join(b, "item_id").select("item_id", T.edit_share(F.col("t"), F.col("u")).alias("share"))


KEYS = {"clinical_safety": ["th", "er"], "social_value": ["ed ", "on"], "interoperability": ["que", "lle"], "service_levels": ["sch", "en"]}


def _hits(t: str) -> str:
    return " + ".join(f"(length(t) - length(replace(t, '{k}', ''))) // {len(k)}" for k in KEYS[t])


@query(
    "WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {i} AS place, '{t}' AS topic, {_hits(t)} AS hits FROM d" for i, t in enumerate(KEYS))
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, place) AS n FROM h WHERE hits > 0),
c AS (SELECT doc_id, string_agg(topic, ',' ORDER BY n) AS topics FROM r WHERE n <= 3 GROUP BY 1)
SELECT doc_id, coalesce(topics, 'clinical_safety') AS topics FROM d LEFT JOIN c USING (doc_id)"""
)
def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by keyword hits (a keyword list that fits the invented texts)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.topics_for(F.col("text"), list(KEYS), KEYS), ",").alias("topics"))


def _sections(spark, sf):
    """Lines of a document as sections; lines with a bar are table rows."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("order_index", "text"))
    return docs.select(F.col("doc_id").alias("document_id"), "order_index", "text", F.contains(F.col("text"), F.lit("|")).alias("is_row"))


@query(
    """WITH l AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS order_index FROM documents),
k AS (SELECT *, contains(text, '|') AS is_row FROM l WHERE trim(text) <> ''),
i AS (SELECT *, sum(CASE WHEN is_row AND coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY order_index) AS island
  FROM (SELECT *, lag(is_row) OVER (PARTITION BY document_id ORDER BY order_index) AS before FROM k)),
o AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY document_id, island ORDER BY order_index) - 1) % 25 = 0 THEN 1 ELSE 0 END AS opens FROM i)
SELECT document_id, CAST(order_index AS INTEGER) AS order_index, CAST(sum(opens) OVER (PARTITION BY document_id ORDER BY order_index) - 1 AS BIGINT) AS batch FROM o"""
)
def row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of table rows in batches of 25, prose alone."""
    return batching.row_batches(_sections(spark, sf_dir)).select("document_id", "order_index", "batch")


@query(
    """WITH RECURSIVE l AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS order_index FROM documents),
sec AS (SELECT document_id, order_index, greatest(1, length(t) // 4) + 30 AS cost FROM l),
fold AS (
  SELECT document_id, order_index, 0 AS win, cost AS used, cost AS last, CAST(-1 AS BIGINT) AS before FROM sec WHERE order_index = 0
  UNION ALL
  SELECT s.document_id, s.order_index, win + CASE WHEN used + s.cost > 6000 THEN 1 ELSE 0 END, CASE WHEN used + s.cost > 6000 THEN last ELSE used END + s.cost, s.cost,
    CASE WHEN used + s.cost > 6000 THEN f.order_index ELSE -1 END
  FROM fold f JOIN sec s ON s.document_id = f.document_id AND s.order_index = f.order_index + 1
)
SELECT document_id, win AS "window", CAST(order_index AS INTEGER) AS order_index FROM fold UNION ALL SELECT document_id, win, CAST(before AS INTEGER) FROM fold WHERE before >= 0"""
)
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping extraction windows of about 6000 tokens."""
    s = _sections(spark, sf_dir).withColumn("tokens", T.estimate_tokens(F.col("text")))
    return batching.token_windows(s)


@query()
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms, by length and hash."""
    n = spans.normalised("text")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", F.length("n").alias("chars"), F.sha1(F.col("n").cast("binary")).alias("sha1"))


@query()
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document with its offsets."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans.sentences("text")).alias("index", "s")).select("doc_id", "index", "s.paragraph", "s.start", "s.end", "s.list_item")


@query()
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of about 400 tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans.chunks("text")).alias("index", "s")).select("doc_id", "index", "s.start", "s.end")


@query()
def located_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text in every document that holds it, verbatim or near; item_id is the document."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return quote_places(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"), quotes)


@query()
def text_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word differences of neighbouring benchmark texts."""
    a = table(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("later"))
    d = a.join(b, "item_id").select("item_id", F.posexplode(spans.diff("text", "later")).alias("index", "d"))
    return d.select("item_id", "index", "d.kind", "d.text")


@query()
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: hashed unit vectors of 64 places."""
    return table(spark, sf_dir, "benchmark").select("item_id", spans.hash_embedding("text", 64).alias("vector"))
