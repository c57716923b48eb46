"""Vectors: hashing, cached embeddings, gathering, pooling, scaling, attention, projection, fusion."""

from pyspark.sql import functions as F

from riskgraph.catalog.base import cte, memory, query, r6, signals, table, wide_table, using
from riskgraph.functions import numeric as N
from riskgraph.functions.text import signed_hash_dense, signed_hash_sparse
from riskgraph.operators import memory as V
from riskgraph.operators.metrics import known  # noqa: F401

DIM = 64

# Signed token hashing vectors of the documents.
cte("hashed", """
  SELECT doc_id, bucket, s / greatest(sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 1) AS value FROM (
    SELECT doc_id, CAST(CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) % 64 AS INTEGER) AS bucket,
           CAST(sum(CASE WHEN h[10:10] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN c ELSE -c END) AS DOUBLE) AS s
    FROM (SELECT doc_id, sha256(w) AS h, count(*) AS c FROM (
            SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY doc_id, w)
    GROUP BY doc_id, bucket) WHERE s <> 0""")


@query(using("hashed", select="SELECT doc_id, bucket, round(value, 6) AS value FROM hashed"))
def hashed_text_features(spark, d):
    docs = wide_table(spark, d, "documents", "doc_id", "text")
    return signed_hash_sparse(docs, "doc_id", "text", DIM).select("doc_id", "bucket", r6("value"))


# A text cache: the smallest document id of each text, with the embedding of its number.
cte("cache", """
  SELECT c.text, e.embedding, e.vec_id FROM (SELECT text, min(doc_id) AS i FROM documents GROUP BY text) c
  JOIN embeddings e ON e.vec_id = c.i % (SELECT count(*) FROM embeddings)""")


def cache(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    texts = wide_table(spark, d, "documents", "doc_id", "text").groupBy("text").agg(F.min("doc_id").alias("i"))
    n = e.agg(F.count("*")).scalar()
    return texts.withColumn("vec_id", F.col("i") % n).join(e, "vec_id").select("text", "embedding", "vec_id")


def by_dimension(df, *keys, **vectors):
    """One row for each dimension, numbered from 1, with the values of ``vectors`` to six decimals."""
    zipped = F.arrays_zip(*[v.alias(name) for name, v in vectors.items()])
    return df.select(*keys, F.posexplode(zipped).alias("p", "v")).select(
        *keys, (F.col("p") + 1).cast("bigint").alias("dim"), *[r6(F.col("v")[name].cast("double"), name) for name in vectors]
    )


@query(using("cache", select="""
  SELECT d.doc_id, c.vec_id, i AS dim, round(c.embedding[i]::DOUBLE, 6) + 0.0 AS value FROM documents d JOIN cache c USING (text), range(1, 65) r(i)"""))
def cached_text_vectors(spark, d):
    c = cache(spark, d)
    docs = wide_table(spark, d, "documents", "doc_id", "text")
    stored = c.select("text", F.struct("vec_id", "embedding").alias("embedding"))
    found = V.vectors_by_text(docs, stored)
    return by_dimension(found.select("doc_id", "embedding.*"), "doc_id", "vec_id", value=F.col("embedding"))


@query("""
  SELECT text_hash FROM (SELECT sha256(text) AS text_hash, text FROM conversations GROUP BY text)
  WHERE text NOT IN (SELECT text FROM conversations WHERE role = 'assistant')""")
def uncached_texts(spark, d):
    turns = table(spark, d, "conversations", "role", "text")
    missing = V.missing_texts(turns, turns.filter(F.col("role") == "assistant"))
    return missing.select(F.sha2("text", 256).alias("text_hash"))


# Each event remembers the vector of its number.
cte("gathered", """
  SELECT m.snapshot, m.node_id, m.slot, m.age_days, m.confidence, e.vec_id, e.embedding FROM memory m
  JOIN embeddings e ON e.vec_id = m.signal_id % (SELECT count(*) FROM embeddings)""", "memory")


def numbered_slots(spark, d):
    """Memory with the number of each slot's vector, and the vectors."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return memory(spark, d).withColumn("vec_id", F.col("signal_id") % e.agg(F.count("*")).scalar()), e


def gathered(spark, d):
    slots, e = numbered_slots(spark, d)
    return V.gather_vectors(slots, e, "vec_id")


@query(using("gathered", select="""
  SELECT snapshot, node_id, slot, vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1e6) AS BIGINT)), ',') AS millionths
  FROM gathered"""))
def gathered_slot_vectors(spark, d):
    """Whole vectors, their components in millionths."""
    millionths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string"))
    return gathered(spark, d).select("snapshot", "node_id", "slot", "vec_id", F.array_join(millionths, ",").alias("millionths"))


@query(using("gathered", select="""
  SELECT snapshot, node_id, i AS dim, round(avg(embedding[i]::DOUBLE), 6) AS value
  FROM gathered, range(1, 65) r(i) GROUP BY snapshot, node_id, i"""))
def pooled_slot_vectors(spark, d):
    pooled = V.pool_signals(*numbered_slots(spark, d), "vec_id", "embedding", DIM)
    return pooled.select("snapshot", "node_id", F.posexplode("pooled").alias("p", "v")).select(
        "snapshot", "node_id", (F.col("p") + 1).cast("bigint").alias("dim"), r6("v", "value")
    )


@query("""
  SELECT i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean,
         round(CASE WHEN stddev_pop(embedding[i]::DOUBLE) > 1e-6 THEN stddev_pop(embedding[i]::DOUBLE) ELSE 1.0 END, 6) AS scale
  FROM embeddings, range(1, 65) r(i) WHERE label < 6 GROUP BY i""")
def fitted_scaler(spark, d):
    train = table(spark, d, "embeddings").filter(F.col("label") < 6)
    fitted = V.fit_scaler(train, "embedding", DIM)
    return fitted.select(F.posexplode(F.arrays_zip("means", "scales")).alias("p", "s")).select(
        F.col("p").cast("bigint").alias("dim"), r6("s.means", "mean"), r6("s.scales", "scale")
    )


@query("""
  SELECT vec_id, i AS dim, round((embedding[i]::DOUBLE - m) / s, 6) + 0.0 AS value
  FROM embeddings, (SELECT i, avg(embedding[i]::DOUBLE) AS m, stddev_pop(embedding[i]::DOUBLE) AS s FROM embeddings, range(1, 65) r(i)
                    WHERE label < 6 GROUP BY i)""")
def scaled_vectors(spark, d):
    e = table(spark, d, "embeddings")
    fitted = V.fit_scaler(e.filter(F.col("label") < 6), "embedding", DIM)
    return by_dimension(V.apply_scaler(e, fitted, "embedding"), "vec_id", value=F.col("embedding"))


cte("attention", """
  SELECT *, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY snapshot, node_id) AS weight FROM (
    SELECT *, max(x) OVER (PARTITION BY snapshot, node_id) AS m FROM (
      SELECT *, embedding[1]::DOUBLE - 0.05 * age_days + confidence AS x FROM gathered))""", "gathered")


def attention(spark, d):
    slots = gathered(spark, d).withColumn("score", F.col("embedding")[0].cast("double"))
    return V.attention_weights(slots)


@query(using("attention", select="SELECT snapshot, node_id, slot, round(weight, 6) AS weight FROM attention"))
def attention_weights(spark, d):
    return attention(spark, d).select("snapshot", "node_id", "slot", r6("weight"))


@query(using("attention", select="""
  SELECT snapshot, node_id, CAST(p AS INTEGER) AS dim, round(sum(weight * embedding[p]::DOUBLE), 6) + 0.0 AS value
  FROM attention, range(1, 65) r(p) GROUP BY snapshot, node_id, p"""))
def attention_pooled(spark, d):
    pooled = V.attention_pool(attention(spark, d), ["snapshot", "node_id"], "embedding", DIM)
    return pooled.select("snapshot", "node_id", F.posexplode("pooled").alias("p", "v")).select(
        "snapshot", "node_id", (F.col("p") + 1).alias("dim"), r6("v", "value")
    )


@query("""
  SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosine(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", r6(N.cosine("embedding", "other"), "similarity"))


# A fixed 3 x 64 projection with entries +1, 0, -1.
MATRIX = [[float((i * j + j) % 3 - 1) for j in range(DIM)] for i in range(3)]


@query("""
  SELECT vec_id, CAST(i AS BIGINT) AS dim, round(p / greatest(sqrt(sum(p * p) OVER (PARTITION BY vec_id)), 1e-12), 6) AS value
  FROM (SELECT vec_id, i, sum(embedding[j + 1]::DOUBLE * ((i * j + j) % 3 - 1)) AS p
        FROM embeddings, range(3) a(i), range(64) b(j) GROUP BY vec_id, i)""")
def projected_vectors(spark, d):
    out = V.random_projection(table(spark, d, "embeddings"), "embedding", MATRIX)
    return out.select("vec_id", F.posexplode("projected").alias("p", "v")).select(
        "vec_id", F.col("p").cast("bigint").alias("dim"), r6("v", "value")
    )


@query("""
  WITH b AS (SELECT a.vec_id, i AS dim, a.embedding[i]::DOUBLE AS l, b.embedding[i]::DOUBLE AS s, a.embedding[2]::DOUBLE AS g
             FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(1, 65) r(i))
  SELECT vec_id, dim, round(l / (1 + exp(-g)) + s * (1 - 1 / (1 + exp(-g))), 6) + 0.0 AS scalar_gate, round((l + s) / 2, 6) + 0.0 AS average,
         round(1 / (1 + exp(-l)) * l + (1 - 1 / (1 + exp(-l))) * s, 6) + 0.0 AS vector_gate,
         round(l, 6) + 0.0 AS concat_long, round(s, 6) + 0.0 AS concat_short,
         round(greatest(l, 0) + ln(1 + exp(-abs(l))), 6) + 0.0 AS softplus, round(greatest(l, 0), 6) + 0.0 AS relu FROM b""")
def fused_memories(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    both = e.select("vec_id", double("embedding").alias("long")).join(
        e.select((F.col("vec_id") - 1).alias("vec_id"), double("embedding").alias("short")), "vec_id"
    )
    gate = F.col("long")[1]
    joined = N.fuse("long", "short", "concat")
    return by_dimension(
        both, "vec_id",
        scalar_gate=N.fuse("long", "short", "scalar", gate), average=N.fuse("long", "short", "average"),
        vector_gate=N.fuse("long", "short", "vector", F.col("long")),
        concat_long=F.slice(joined, 1, DIM), concat_short=F.slice(joined, DIM + 1, DIM),
        softplus=F.transform("long", N.softplus), relu=F.transform("long", N.relu),
    )


@query("""
  SELECT vec_id, dim, round((embedding[dim]::DOUBLE - m) / sqrt(v + 1e-5), 6) + 0.0 AS normed,
         round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * (i % 3 - 1))) + 0.5, 6) AS head
  FROM (SELECT *, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS m,
               list_var_pop(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings), range(1, 65) r(dim)""")
def normed_vectors(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    weights = [float((i + 1) % 3 - 1) for i in range(DIM)]
    return by_dimension(e.withColumn("head", r6(N.affine("embedding", weights, 0.5))), "vec_id", "head", normed=N.layer_norm("embedding"))


@query(using("memory", select="""
  SELECT snapshot, node_id, array_to_string(list_transform(range(5), lambda s: coalesce(list(signal_id) FILTER (slot = s)[1], -1)), ',') AS ids
  FROM memory GROUP BY snapshot, node_id""").replace("list_transform(range(5), lambda s: coalesce(list(signal_id) FILTER (slot = s)[1], -1))",
    "[" + ", ".join(f"coalesce(max(signal_id) FILTER (slot = {s}), -1)" for s in range(5)) + "]"))
def dense_memory_slots(spark, d):
    dense = V.slots_to_arrays(memory(spark, d), ["snapshot", "node_id"], 5, "signal_id", -1)
    return dense.select("snapshot", "node_id", F.array_join(F.transform("signal_id", lambda x: x.cast("string")), ",").alias("ids"))


@query(using("memory", select="SELECT snapshot, node_id, slot, signal_id FROM memory"))
def memory_round_trip(spark, d):
    dense = V.slots_to_arrays(memory(spark, d), ["snapshot", "node_id"], 5, "signal_id", -1)
    return V.arrays_to_slots(dense, ["snapshot", "node_id"], "signal_id", -1)


@query(using("nodes", select="""
  SELECT node_id, i AS position, CASE WHEN i = list_position(['customer', 'nation', 'part', 'region', 'supplier'], node_type) - 1 THEN 1.0 ELSE 0.0 END AS value
  FROM nodes, range(8) r(i)"""))
def node_type_one_hot(spark, d):
    from riskgraph.catalog.base import nodes

    kinds = F.array(*[F.lit(t) for t in ("customer", "nation", "part", "region", "supplier")])
    index = (F.array_position(kinds, F.col("node_type")) - 1).cast("int")
    return nodes(spark, d).select("node_id", F.posexplode(N.one_hot(index, 8)).alias("p", "value")).select(
        "node_id", F.col("p").cast("bigint").alias("position"), "value"
    )
