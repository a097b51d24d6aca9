"""The named queries over the driver's tables and the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions import config
from quillmesh.functions.similarity import similarity, tier
from quillmesh.operators import bloom, dedup, integrity, ops, predict, search, stats, texts, versions
from quillmesh.sources import index
from quillmesh.sources import tables as T
from quillmesh.sources.shared import new_folder
from quillmesh.streaming import commits

#: The posting that most queries ask about, results, breadth, and rows a shard may hold.
ASKED, K, SLOP, CAPACITY = 3, 10, 3, 60
QUERIES, ORACLES = {}, {}

# DuckDB's side: the inputs of quillmesh.sources.tables as common table expressions
P = "p as (select vec_id % 50 as document_id, (vec_id % 7) * 10 as start, 10::bigint as length, label::bigint as shard_id, vec_id as seq, list_transform(embedding, lambda x: x::double * (1 + vec_id % 5)) as vector from embeddings)"
L = P + ", l as (select * from p qualify row_number() over (partition by shard_id, document_id, start, length order by seq desc) = 1)"
V = L + ", v as (select * from l where document_id % 11 <> 0)"
Q = f", q as (select vector as qv from p where seq = {ASKED})"
SCORE = {
    "cosine": "round((greatest(-1, least(1, list_cosine_similarity(vector, qv))) + 1) / 2, 6)",
    "euclidean": "round(1 / (1 + list_distance(vector, qv)), 6)",
    "dot": "round(1 / (1 + exp(-list_dot_product(vector, qv))), 6)",
}
CENTROIDS = "c as (select shard_id, list(x order by i) as centroid from (select shard_id, i, avg(x) as x from (select shard_id, unnest(vector) as x, generate_subscripts(vector, 1) as i from v) group by shard_id, i) group by shard_id)"
NEAR = f"n as (select shard_id, row_number() over (order by round(list_distance(centroid, qv), 6), shard_id) as shard_rank from c, q qualify shard_rank <= {SLOP})"
HITS = f"h as (select v.*, shard_rank, {SCORE['cosine']} as score from v join n on v.shard_id = n.shard_id, q)"
CAPPED = "k as (select * from h qualify row_number() over (partition by shard_id order by score desc, seq desc) <= 50)"
TX = "x as (select doc_id as document_id, 1 as version, text, false as deleted from documents union all select doc_id, 2, 'v2 ' || text, doc_id % 9 = 0 from documents where doc_id % 3 = 0)"
TL = TX + ", t as (select * from (select * from x qualify row_number() over (partition by document_id order by version desc) = 1) where not deleted)"
O = (
    "o as (select vec_id // 100 as txn_id, vec_id % 100 as op_ordinal, 'add_posting' as op, vec_id % 50 as document_id, (vec_id % 7) * 10 as start, vec_id % 13 as length, list_transform(embedding, lambda x: x::double) as vector, null::varchar as text from embeddings"
    " union all select vec_id // 100, 100, 'remove_document', vec_id // 100, null, null, null, null from embeddings where vec_id % 100 = 37"
    " union all select doc_id // 100, 200 + doc_id % 100, 'store_text', doc_id % 60, null, null, null, text from documents)"
)
M = "m as (select ts, event_type as op_type, round(value * 1000)::bigint as latency_us, event_id % 100 <> 0 as success, case when event_id % 4 = 0 then null else event_id % 3 = 0 end as bloom_hit, event_id % 30 = 3 as bloom_false_positive from events)"
A = "a as (select user_id as document_id, ts, event_id as pos from events)"


def query(sql: str | None = None):
    """Register the function under its own name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def live(spark: SparkSession, sf: str) -> DataFrame:
    return versions.latest(versions.buried(T.postings(spark, sf), T.deletes(spark, sf))).where("not deleted")


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Scored postings of the nearest shards, before dedup."""
    q, rows = T.vector_of(spark, sf, ASKED), live(spark, sf)
    near = search.nearest_shards(search.centroids(rows), q, SLOP)
    near = near.withColumn("shard_rank", F.row_number().over(Window.orderBy("distance", "shard_id")))
    return search.scored(rows.join(F.broadcast(near), "shard_id"), q, "cosine")


def exact(metric: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return search.search_exact(T.postings(spark, sf), T.vector_of(spark, sf, ASKED), K, metric)

    run.__name__ = f"knn_{metric}_exact"
    return query(f"with {L}{Q} select document_id, start, length, seq, {SCORE[metric]} as score from l, q order by score desc, document_id, start, length, seq limit {K}")(run)


for m in ("cosine", "euclidean", "dot"):
    exact(m)


@query("""select * from (values ('dot', 'empty', 0.5), ('dot', 'nan', 0.5), ('dot', 'zero', 0.5), ('dot', 'same', round(1 / (1 + exp(-25::double)), 6)), ('dot', 'opposite', round(1 / (1 + exp(25::double)), 6)),
  ('cosine', 'empty', 0.5), ('cosine', 'nan', 0.5), ('cosine', 'zero', 0.5), ('cosine', 'same', 1), ('cosine', 'opposite', 0),
  ('euclidean', 'empty', 0.5), ('euclidean', 'nan', 0.5), ('euclidean', 'zero', round(1 / 6::double, 6)), ('euclidean', 'same', 1), ('euclidean', 'opposite', round(1 / 11::double, 6))) as t(metric, name, score)""")
def metric_edge_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("empty", [], []), ("nan", [float("nan"), 1.0], [3.0, 4.0]), ("zero", [0.0, 0.0], [3.0, 4.0]), ("same", [3.0, 4.0], [3.0, 4.0]), ("opposite", [-3.0, -4.0], [3.0, 4.0])]
    df = spark.createDataFrame(rows, "name string, a array<double>, b array<double>")
    kinds = ", ".join(f"struct('{m}' as metric, round({similarity(m, 'a', 'b')}, 6) as score)" for m in ("dot", "cosine", "euclidean"))
    return df.selectExpr("name", f"inline(array({kinds}))").select("metric", "name", "score")


@query(f"with {L}{Q}, s as (select {SCORE['cosine']} as score from l, q) select case when score >= 0.8 then 'high' when score >= 0.5 then 'moderate' when score >= 0.3 then 'weak' else 'low' end as tier, count(*) as n from s group by 1")
def similarity_tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.scored(versions.latest(T.postings(spark, sf)), T.vector_of(spark, sf, ASKED), "cosine")
    return rows.groupBy(F.expr(tier("score")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {L}{Q}, s as (select seq, {SCORE['cosine']} as score from l, q), r as (select avg(score) as mean from s) select seq, score, abs(score - mean) <= 0.02 as similar_to_mean from s, r")
def similarity_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.scored(versions.latest(T.postings(spark, sf)), T.vector_of(spark, sf, ASKED), "cosine").select("seq", "score")
    return rows.join(F.broadcast(rows.agg(F.avg("score").alias("mean")))).selectExpr("seq", "score", "abs(score - mean) <= 0.02D as similar_to_mean")


def flat(c: DataFrame) -> DataFrame:
    return c.select("shard_id", F.posexplode("centroid").alias("i", "x")).selectExpr("shard_id", "cast(i as bigint) as i", "round(x, 6) as x")


@query(f"with {L} select shard_id, (i - 1)::bigint as i, round(avg(x), 6) as x from (select shard_id, unnest(vector) as x, generate_subscripts(vector, 1) as i from l) group by shard_id, i")
def shard_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return flat(search.centroids(versions.latest(T.postings(spark, sf))))


@query(f"with {V} select shard_id, (i - 1)::bigint as i, round(avg(x), 6) as x from (select shard_id, unnest(vector) as x, generate_subscripts(vector, 1) as i from v) group by shard_id, i")
def shard_centroids_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    return flat(search.centroids(live(spark, sf)))


@query(f"with {V}{Q}, {CENTROIDS} select shard_id, round(list_distance(centroid, qv), 6) as distance from c, q order by 2, 1 limit {SLOP}")
def nearest_shards(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest_shards(search.centroids(live(spark, sf)), T.vector_of(spark, sf, ASKED), SLOP)


@query(f"with {V}, {CENTROIDS}, d as (select p.seq as id, c.shard_id, round(list_distance(vector, centroid), 6) as distance from p, c) select id, shard_id, distance from d qualify row_number() over (partition by id order by distance, shard_id) = 1")
def nearest_shard_assignment(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.postings(spark, sf).select(F.col("seq").alias("id"), "vector")
    return search.assigned(rows, search.centroids(live(spark, sf))).select("id", "shard_id", "distance")


@query(f"with {V}{Q}, {CENTROIDS}, {NEAR}, {HITS}, {CAPPED}, u as (select * from k qualify row_number() over (partition by document_id, start order by shard_rank, score desc, seq desc) = 1) select document_id, start, length, shard_id, seq, score from u order by score desc, document_id, start, length limit {K}")
def knn_slop_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = versions.buried(T.postings(spark, sf), T.deletes(spark, sf))
    return search.search(rows, T.vector_of(spark, sf, ASKED), K, SLOP)


NEAREST = f"""e as (select vec_id as id, label::bigint as label, embedding::double[] as vector from embeddings),
  b as (select q.id as query_id, e.id, round((greatest(-1, least(1, list_cosine_similarity(e.vector, q.vector))) + 1) / 2, 6) as score from e, e as q where q.id % 50 = 0),
  t as (select query_id, id from b qualify row_number() over (partition by query_id order by score desc, id) <= {K}),
  c as (select label as shard_id, list(x order by i) as centroid from (select label, i, avg(x) as x from (select label, unnest(vector) as x, generate_subscripts(vector, 1) as i from e) group by label, i) group by label),
  r as (select e.id as query_id, c.shard_id, row_number() over (partition by e.id order by round(list_distance(c.centroid, e.vector), 6), c.shard_id) as slop from e, c where e.id % 50 = 0)"""


def recall(shards: str) -> str:
    return f"h as ({shards}), n as (select slop, count(*) as n from h join r on h.query_id = r.query_id and h.shard_id = r.shard_id group by 1) select slop::bigint as slop, round(sum(n) over (order by slop) / (select count(*) from t)::double, 6) as recall from n"


def asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those to ask about (every id divisible by 50)."""
    rows = T.table(spark, sf, "embeddings").selectExpr("vec_id as id", "cast(label as bigint) as label", "transform(embedding, x -> cast(x as double)) as vector")
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return rows, queries


def exact_nearest(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return search.search_batch(rows, ((r.query_id, r.vector) for r in queries.orderBy("query_id").toLocalIterator()), K)


@query(f"with {NEAREST}, {recall('select t.query_id, e.label as shard_id from t join e on t.id = e.id')}")
def knn_recall_by_slop(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the exact nearest a search of each breadth sees if shards are the labels given."""
    rows, queries = asked(spark, sf)
    best = exact_nearest(rows, queries)
    shards = search.centroids(rows.withColumn("shard_id", F.col("label")))
    return index.recall_by_slop(best.join(rows, "id").select("query_id", F.col("label").alias("shard_id")), queries, shards).selectExpr("cast(slop as bigint) as slop", "recall")


@query(f"with {NEAREST}, a as (select e.id, c.shard_id from e, c qualify row_number() over (partition by e.id order by round(list_distance(c.centroid, e.vector), 6), c.shard_id) = 1), {recall('select t.query_id, a.shard_id from t join a on t.id = a.id')}")
def knn_recall_routed(spark: SparkSession, sf: str) -> DataFrame:
    """The same if every posting is routed to the nearest of those centroids, as an index does."""
    rows, queries = asked(spark, sf)
    best = exact_nearest(rows, queries)
    shards = search.centroids(rows.withColumn("shard_id", F.col("label")))
    routed = search.assigned(rows.select("id", "vector"), shards).select("id", "shard_id")
    return index.recall_by_slop(best.join(routed, "id").select("query_id", "shard_id"), queries, shards).selectExpr("cast(slop as bigint) as slop", "recall")


@query()
def index_tuned_search(spark: SparkSession, sf: str) -> DataFrame:
    """An index of all embeddings with 40 shards and more, searched with the slop that tune() finds for a recall of 0.9:
    its size and what the search sees."""
    rows, queries = asked(spark, sf)
    at = new_folder(spark, "indexes")
    ix = index.Index.create(spark, at, config.Config(vector_size=64, shard_size=max(1, rows.count() // 30)))
    ix.add(rows.selectExpr("id + 1 as document_id", "0L as start", "1L as length", "vector"), flush=True)
    slop = ix.tune(queries)
    found = ix.recall(queries).where(F.col("slop") <= slop).agg(F.max("recall").alias("recall"))
    return found.select(F.lit(ix.shards().count()).alias("n_shards"), F.lit(ix.postings().count()).alias("n_postings"), F.lit(slop).alias("slop"), "recall")


@query(f"""with e as (select vec_id as id, embedding::double[] as vector from embeddings), s as (select q.id as query_id, e.id, round((greatest(-1, least(1, list_cosine_similarity(e.vector, q.vector))) + 1) / 2, 6) as score from e, e as q where q.id % 50 = 0)
  select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= {K}""")
def knn_batch_queries(spark: SparkSession, sf: str) -> DataFrame:
    return exact_nearest(*asked(spark, sf))


@query(f"with {V}{Q}, h as (select v.*, {SCORE['cosine']} as score from v, q) select shard_id, seq, score, row_number() over (partition by shard_id order by score desc, seq desc) as place from h qualify place <= 50")
def per_shard_candidate_cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.scored(live(spark, sf), T.vector_of(spark, sf, ASKED), "cosine")
    best = Window.partitionBy("shard_id").orderBy(F.desc("score"), F.desc("seq"))
    return rows.withColumn("place", F.row_number().over(best).cast("long")).where("place <= 50").select("shard_id", "seq", "score", "place")


ROWS = ["shard_id", "document_id", "start", "length", "seq"]


@query(f"with {L} select {', '.join(ROWS)} from l")
def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    return versions.latest(T.postings(spark, sf)).select(*ROWS)


@query(f"with {V} select {', '.join(ROWS)} from v")
def live_after_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    return live(spark, sf).select(*ROWS)


KEYS = {"none": None, "by_document": "document_id order by score desc, shard_rank, seq desc", "by_position": "document_id, start order by shard_rank, score desc, seq desc", "exact": "document_id, start, length, list_transform(vector, lambda x: round(x * 1000000)::bigint) order by shard_rank, score desc, seq desc"}


def kept(policy: str) -> str:
    return "" if KEYS[policy] is None else f" qualify row_number() over (partition by {KEYS[policy]}) = 1"


def dedup_query(policy: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return dedup.deduplicated(hits(spark, sf), policy).select("document_id", "start", "seq", "score")

    run.__name__ = f"dedup_{policy}"
    return query(f"with {V}{Q}, {CENTROIDS}, {NEAR}, {HITS} select document_id, start, seq, score from h{kept(policy)}")(run)


for m in KEYS:
    dedup_query(m)


@query(" union all ".join(f"select * from (with {V}{Q}, {CENTROIDS}, {NEAR}, {HITS}, u as (select * from h{kept(p)}), c1 as (select count(*) as a from h), c2 as (select count(*) as b from u) select '{p}' as policy, a as processed, a - b as removed, b as kept, round(1 - (a - b) / a::double, 6) as efficiency from c1, c2)" for p in KEYS))
def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = hits(spark, sf)
    first, *others = (dedup.dedup_stats(rows, p) for p in KEYS)
    for o in others:
        first = first.unionByName(o)
    return first


@query(f"with {L}, i as (select unnest(range(0, 60, 4)) as document_id), n as (select document_id, count(*) as n from l group by 1) select i.document_id, coalesce(n, 0)::bigint as removed from i left join n on i.document_id = n.document_id")
def delete_documents_counts(spark: SparkSession, sf: str) -> DataFrame:
    return versions.delete_counts(T.postings(spark, sf), spark.range(0, 60, 4).withColumnRenamed("id", "document_id"))


@query(f"with {L} select {', '.join(ROWS)} from l where not (document_id % 4 = 0 and document_id < 60)")
def delete_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return versions.survivors(T.postings(spark, sf), spark.range(0, 60, 4).withColumnRenamed("id", "document_id")).select(*ROWS)


@query(f"with {P}, d as (select p.*, row_number() over (partition by shard_id, document_id, start, length order by seq desc) = 1 as newest from p) select document_id, shard_id, seq, newest and document_id % 11 <> 0 as current from d where document_id % 4 = 0")
def slots_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = versions.buried(T.postings(spark, sf), T.deletes(spark, sf))
    return versions.slots_of(rows, spark.range(0, 60, 4).withColumnRenamed("id", "document_id"))


@query(f"with {P} select document_id, start, length, seq from p where shard_id = (select shard_id from p where seq = {ASKED}) and seq = {ASKED}")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.postings(spark, sf)
    shard = rows.where(F.col("seq") == ASKED).first().shard_id
    return versions.point_lookup(rows, shard, ASKED).select("document_id", "start", "length", "seq")


@query(f"with {P} select distinct document_id, shard_id from p where document_id % 4 = 0")
def exact_candidate_shards(spark: SparkSession, sf: str) -> DataFrame:
    return versions.candidate_shards(T.postings(spark, sf), spark.range(0, 60, 4).withColumnRenamed("id", "document_id"))


@query()
def bloom_candidate_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.postings(spark, sf)
    return bloom.candidate_shards(bloom.filters(rows, 1024, 0.01), spark.range(0, 60, 4).withColumnRenamed("id", "document_id"), 1024, 0.01)


@query("select n::bigint as n, rate, ceil(-n * ln(rate) / (ln(2) * ln(2)))::bigint as bits, greatest(1, least(10, ceil(ceil(-n * ln(rate) / (ln(2) * ln(2))) / n * ln(2))))::bigint as hashes from (values (1000, 0.01::double), (1000, 0.001), (50000, 0.05), (10, 0.5)) as t(n, rate)")
def bloom_parameters(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, p, *config.bloom_parameters(n, p)) for n, p in ((1000, 0.01), (1000, 0.001), (50000, 0.05), (10, 0.5))]
    return spark.createDataFrame(rows, "n long, rate double, bits long, hashes long")


@query()
def shard_split_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return versions.split(live(spark, sf))


@query(f"""with {V}, w as (select *, row_number() over (partition by shard_id order by seq desc) as i from v),
  d as (select a.shard_id, a.seq as seq_a, b.seq as seq_b, round(list_distance(a.vector, b.vector), 6) as distance, a.i as i, b.i as j from w a join w b on a.shard_id = b.shard_id and a.i < b.i)
  select shard_id, seq_a, seq_b, distance from d qualify row_number() over (partition by shard_id order by distance desc, i, j) = 1""")
def furthest_pair_per_shard(spark: SparkSession, sf: str) -> DataFrame:
    return versions.furthest_pairs(live(spark, sf))


STATS = "s as (select p.shard_id, count(*) as total_count, (select count(*) from v where v.shard_id = p.shard_id) as active_count from p group by 1)"


@query(f"with {V}, {STATS} select shard_id, total_count, active_count, total_count - active_count as inactive_count, round(active_count / {CAPACITY}::double, 6) as utilization, total_count >= floor(0.9 * {CAPACITY}) as should_split, active_count / {CAPACITY}::double >= 0.9 as overfull, total_count >= {CAPACITY} as is_full, greatest({CAPACITY} - total_count, 0) as remaining from s")
def shard_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.shard_stats(versions.buried(T.postings(spark, sf), T.deletes(spark, sf)), CAPACITY)


@query(f"with {V}, {STATS} select count(*) as n_shards, sum(total_count)::bigint as total_postings, sum(active_count)::bigint as active_postings, sum(total_count - active_count)::bigint as inactive_postings, round(avg(round(active_count / {CAPACITY}::double, 6)), 6) as average_utilization, (sum(total_count) * 320)::bigint as disk_bytes, 64 as dimension from s")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.index_stats(versions.buried(T.postings(spark, sf), T.deletes(spark, sf)), CAPACITY, 64)


@query(f"with {V}, {STATS} select shard_id, round(active_count / {CAPACITY}::double, 6) as utilization, row_number() over (order by active_count desc, shard_id) as place from s where active_count / {CAPACITY}::double >= 0.9")
def shards_to_split(spark: SparkSession, sf: str) -> DataFrame:
    """The fullest first, by live rows."""
    rows = shard_stats(spark, sf).where("overfull").select("shard_id", "utilization")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("utilization"), "shard_id")).cast("long"))  # one row a shard


@query(f"with {V}, {STATS} select shard_id, round(active_count / {CAPACITY}::double, 6) as utilization from s where round(active_count / {CAPACITY}::double, 6) < 0.8 and total_count > 0")
def underutilized_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shard_stats(spark, sf).where("utilization < 0.8D and total_count > 0").select("shard_id", "utilization")


@query(f"with {TL} select document_id, version::bigint as version, text from t")
def latest_document_text(spark: SparkSession, sf: str) -> DataFrame:
    return texts.latest_texts(T.texts(spark, sf))


REQUESTS = "r as (select doc_id as document_id, doc_id % 40 as start, case when doc_id % 17 = 0 then 0 when doc_id % 19 = 0 then 1000000 else 50 end as length from documents)"
FAULT = "case when text is null then 'no text' when length <= 0 then 'empty range' when start > octet_length(encode(text)) then 'start beyond text' when start + length > octet_length(encode(text)) then 'end beyond text' when try(decode(encode(text)[start + 1 : start + length])) is null then 'inside a character' end"


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").selectExpr("doc_id as document_id", "doc_id % 40 as start", "case when doc_id % 17 = 0 then 0L when doc_id % 19 = 0 then 1000000L else 50L end as length")


@query(f"with {TL}, {REQUESTS}, f as (select r.*, text, {FAULT} as fault from r left join t on r.document_id = t.document_id) select document_id, start, length::bigint as length, case when fault is null then decode(encode(text)[start + 1 : start + length]) end as snippet, fault from f")
def snippet_extract_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return texts.snippets(texts.latest_texts(T.texts(spark, sf)), requests(spark, sf))


@query(f"with {TL}, {REQUESTS}, f as (select {FAULT} as fault from r left join t on r.document_id = t.document_id) select coalesce(fault, 'fine') as fault, count(*) as n from f group by 1")
def snippet_range_validation(spark: SparkSession, sf: str) -> DataFrame:
    return snippet_extract_bytes(spark, sf).groupBy(F.coalesce("fault", F.lit("fine")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {L}{Q}, {TX}, t as (select * from (select * from x qualify row_number() over (partition by document_id order by version desc) = 1) where not deleted), e as (select document_id, start, length, seq, {SCORE['cosine']} as score from l, q order by score desc, document_id, start, length, seq limit {K}) select e.document_id, start, length, score, text from e left join t on e.document_id = t.document_id")
def search_with_text(spark: SparkSession, sf: str) -> DataFrame:
    found = search.search_exact(T.postings(spark, sf), T.vector_of(spark, sf, ASKED), K)
    return found.join(texts.latest_texts(T.texts(spark, sf)), "document_id", "left").select("document_id", "start", "length", "score", "text")


@query("with p as (select vec_id % 50 as document_id, vec_id * 7 % 500 as start, vec_id % 13 as length, vec_id as seq from embeddings), u as (select *, max(start + length) over (partition by document_id order by start, seq rows between unbounded preceding and 1 preceding) as upto from p) select document_id, count(*) filter (where start < upto) as n_overlapping from u group by 1")
def overlapping_postings(spark: SparkSession, sf: str) -> DataFrame:
    return texts.overlaps(T.table(spark, sf, "embeddings").selectExpr("vec_id % 50 as document_id", "vec_id * 7 % 500 as start", "vec_id % 13 as length", "vec_id as seq"))


@query(f"with {TX} select count(*) as n_versions, count(distinct document_id) as n_documents, sum(octet_length(encode(text)))::bigint as total_bytes, (sum(octet_length(encode(text))) // count(*))::bigint as average_bytes from x")
def document_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    return texts.text_stats(T.texts(spark, sf))


FOLD = f"{O}, r as (select document_id, max(txn_id * 1000 + op_ordinal) as gone from o where op = 'remove_document' group by 1), s as (select o.* from o left join r on o.document_id = r.document_id where op = 'add_posting' and (gone is null or txn_id * 1000 + op_ordinal > gone) qualify row_number() over (partition by o.document_id, start, length order by txn_id desc, op_ordinal desc) = 1)"


@query(f"with {FOLD} select document_id, start, length, txn_id, op_ordinal from s")
def ops_fold_state(spark: SparkSession, sf: str) -> DataFrame:
    return ops.postings_of(T.operations(spark, sf)).drop("vector")


@query(f"with {O} select document_id, text from o where op = 'store_text' qualify row_number() over (partition by document_id order by txn_id desc, op_ordinal desc) = 1")
def replace_document_fold(spark: SparkSession, sf: str) -> DataFrame:
    return ops.texts_of(T.operations(spark, sf))


@query(f"with {O}, z as (select * from o where txn_id % 2 = 1) select txn_id, op, count(*) as n from z group by 1, 2")
def replay_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """The log is delivered twice; transactions with even numbers were applied before."""
    log = T.operations(spark, sf)
    done = log.where("txn_id % 2 = 0").select("txn_id")
    return ops.unprocessed(log.union(log), done).groupBy("txn_id", "op").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {O}, s as (select count(distinct txn_id) as n_transactions, count(distinct case when txn_id % 2 = 1 then txn_id end) as n_replayed, count(distinct case when txn_id % 2 = 0 then txn_id end) as n_skipped, count(*) filter (where txn_id % 2 = 1 and op = 'add_posting') as n_add_posting, count(*) filter (where txn_id % 2 = 1 and op = 'remove_document') as n_remove_document, count(*) filter (where txn_id % 2 = 1 and op = 'store_text') as n_store_text from o) select *, round(100.0::double * n_replayed / n_transactions, 6) as success_rate from s")
def replay_statistics(spark: SparkSession, sf: str) -> DataFrame:
    log = T.operations(spark, sf)
    return ops.replay_stats(log, log.where("txn_id % 2 = 0").select("txn_id"))


BYTES = "case op when 'add_posting' then 29 + 4 * len(vector) when 'store_text' then 21 + octet_length(encode(text)) else 17 end"


@query(f"with {O} select op, count(*) as n, sum({BYTES})::bigint as bytes from o group by 1")
def op_size_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return ops.sized(T.operations(spark, sf)).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(f"""with recursive {O}, z as (select txn_id, {BYTES} as bytes, row_number() over (partition by txn_id order by op_ordinal) as i from o),
  w as (select txn_id, i, 0::bigint as batch, 1::bigint as n, bytes::bigint as total from z where i = 1
    union all select z.txn_id, z.i, w.batch + (w.n >= 64 or w.total > 40000)::bigint, case when w.n >= 64 or w.total > 40000 then 1 else w.n + 1 end, case when w.n >= 64 or w.total > 40000 then z.bytes else w.total + z.bytes end
    from w join z on z.txn_id = w.txn_id and z.i = w.i + 1)
  select txn_id, batch, max(n) as n_ops, max(total) as bytes from w group by 1, 2""")
def batch_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return ops.batches(T.operations(spark, sf), 64, 40_000)


@query(f"with {O}, f as (select case when document_id is null or document_id = 0 then 'no document id' when op = 'add_posting' and length <= 0 then 'length is zero' when op = 'store_text' and octet_length(encode(text)) > 4000 then 'text too long' end as fault from o) select coalesce(fault, 'fine') as fault, count(*) as n from f group by 1")
def op_validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.validated(T.operations(spark, sf), 64, 4000)
    return rows.groupBy(F.coalesce("fault", F.lit("fine")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {O} select distinct txn_id, document_id from o")
def affected_document_ids(spark: SparkSession, sf: str) -> DataFrame:
    return T.operations(spark, sf).select("txn_id", "document_id").distinct()


@query(f"with {M} select op_type, count(*) as n, round(avg(greatest(1, latency_us)), 6) as mean_us, min(greatest(1, latency_us)) as min_us, max(greatest(1, latency_us)) as max_us, quantile_disc(greatest(1, latency_us), 0.5) as p50_us, quantile_disc(greatest(1, latency_us), 0.95) as p95_us, quantile_disc(greatest(1, latency_us), 0.99) as p99_us from m group by 1")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.latency_percentiles(T.metrics(spark, sf))


@query(f"with {M} select op_type, count(*) as n, round(sum(latency_us) / count(*)::double, 6) as mean_us, round(sum(latency_us) / (select sum(latency_us) from m)::double, 6) as share, (select round(sum(latency_us) / count(*)::double, 6) from m) as overall_mean_us from m group by 1")
def per_op_latency(spark: SparkSession, sf: str) -> DataFrame:
    return stats.per_op_latency(T.metrics(spark, sf))


@query(f"with {M}, w as (select max(ts) as newest from m) select count(*) as n_ops, round(count(*) / 3600::double, 6) as ops_per_second from m, w where ts > newest - interval 3600 seconds")
def throughput_last_hour(spark: SparkSession, sf: str) -> DataFrame:
    return stats.throughput(T.metrics(spark, sf), 3600)


@query(f"with {M}, s as (select count(*) filter (where bloom_hit) as hits, count(*) filter (where not bloom_hit) as misses, count(*) filter (where bloom_false_positive) as f from m) select hits, misses, round(hits / (hits + misses)::double, 6) as hit_rate, round(f / hits::double, 6) as false_positive_rate from s")
def hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    return stats.hit_rates(T.metrics(spark, sf))


@query(f"with {M} select op_type, round(count(*) filter (where success) / count(*)::double, 6) as success_rate, quantile_disc(latency_us, 0.95) as p95_us, quantile_disc(latency_us, 0.95) < 1000000 and round(count(*) filter (where success) / count(*)::double, 6) >= 0.99 as healthy from m group by 1")
def performance_health(spark: SparkSession, sf: str) -> DataFrame:
    return stats.health(T.metrics(spark, sf))


@query(f"with {P}, w as (select shard_id, vector[1] as x, seq from p), s as (select shard_id, count(*) as n, round(count(*) filter (where seq % 7 = 0) / count(*)::double, 6) as has_nan, round(count(*) filter (where seq % 11 = 0 and seq % 7 <> 0) / count(*)::double, 6) as has_inf, 0.0::double as all_zero from w group by 1), i as (select *, case when has_nan > 0.10 then 'nan' when has_inf > 0.05 then 'infinite' end as issue from s) select *, case issue when 'nan' then 0.8 when 'infinite' then 0.7 end::double as severity from i")
def vector_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh vector has a NaN put in, of the others every eleventh an infinity."""
    spoilt = "transform(vector, (x, i) -> cast(case when i = 0 and seq % 7 = 0 then double('NaN') when i = 0 and seq % 11 = 0 then double('Infinity') else x end as float)) as vector"
    return integrity.vector_quality(T.postings(spark, sf).selectExpr("shard_id", spoilt))


@query("with p as (select label::bigint as shard_id, vec_id % 50 as document_id, vec_id as start, vec_id % 13 as length from embeddings), s as (select shard_id, count(*) as n, count(*) filter (where document_id = 0) as n_invalid_id, count(*) filter (where length = 0) as n_zero_length, 0::bigint as n_too_long, 0::bigint as n_overflow from p group by 1) select *, concat_ws(',', case when n > 52 then 'over capacity' end, case when n_invalid_id > 0.1 * n then 'invalid ids' end, case when n_zero_length > 0.05 * n then 'zero lengths' end) as issues from s")
def posting_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "embeddings").selectExpr("cast(label as bigint) as shard_id", "vec_id % 50 as document_id", "vec_id as start", "vec_id % 13 as length")
    return integrity.posting_quality(rows, 52)


@query(f"with {P}, w as (select shard_id, document_id, lag(document_id) over (partition by shard_id order by seq) as before from p), s as (select shard_id, count(before) as n_pairs, count(*) filter (where document_id < before) as n_violations from w group by 1) select *, n_violations > 0.3 * n_pairs as disordered from s")
def ordering_violations(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.ordering_violations(T.postings(spark, sf))


@query("select 'posting without vector' as issue, count(*) filter (where vec_id % 5 = 0 and vec_id % 3 <> 0) as n, 0.9::double as severity from embeddings union all select 'vector without posting', count(*) filter (where vec_id % 3 = 0 and vec_id % 5 <> 0), 0.7 from embeddings")
def cross_reference_issues(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.postings(spark, sf)
    return integrity.cross_references(rows.where("seq % 3 <> 0"), rows.where("seq % 5 <> 0"))


ISSUES = f"""i as (select kind, (vec_id % 20) / 20::double as severity, vec_id % 3 > 0 as recoverable, vec_id from (select vec_id, ['header', 'data', 'truncation', 'structure', 'cross_validation', 'partial'][1 + vec_id % 6] as kind from embeddings))"""
RANKED = """k as (select *, case when kind in ('header', 'structure') then 1 when kind in ('cross_validation', 'truncation') then 2 when kind = 'data' then (case when severity > 0.8 then 1 else 2 end) else (case when severity > 0.5 then 3 else 4 end) end as priority,
  kind in ('header', 'structure') or severity > 0.9 as blocking, case kind when 'header' then 5 when 'truncation' then 5 when 'structure' then 4 when 'cross_validation' then 3 else 2 end as difficulty,
  kind in ('data', 'partial', 'cross_validation') and recoverable as auto_repairable from i)"""


def issues(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ", ".join(f"'{c[0]}'" for c in integrity.CORRUPTIONS)
    rows = T.table(spark, sf, "embeddings").selectExpr("vec_id", f"array({kinds})[vec_id % 6] as kind", "vec_id % 20 / 20D as severity", "vec_id % 3 > 0 as recoverable")
    return integrity.ranked_issues(rows)


@query(f"with {ISSUES}, {RANKED} select vec_id, kind, severity, recoverable, priority, blocking, difficulty, auto_repairable from k")
def issue_priority(spark: SparkSession, sf: str) -> DataFrame:
    return issues(spark, sf)


@query(f"with {ISSUES}, {RANKED} select count(*) as n_issues, count(*) filter (where blocking) as n_blocking, count(*) filter (where auto_repairable) as n_auto_repairable, max(severity) as worst, min(priority) as first_priority, false as valid from k")
def integrity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.integrity_summary(issues(spark, sf))


USER = 8
SEQ = f"{A}, n as (select count(*) as n from a), q as (select b.document_id as next_id, round(sum(1.0::double / (n - a.pos)), 6) as score from a join a b on b.pos = a.pos + 1, n where a.document_id = {USER} group by 1)"
CO = f"""w as (select a.pos, a.document_id, b.document_id as partner_id, min(a.pos - b.pos) as back, count(*) as times from a join a b on b.pos between a.pos - 9 and a.pos - 1 and b.document_id <> a.document_id and a.ts - b.ts <= interval 1800 seconds group by 1, 2, 3),
  co as (select document_id, partner_id, round(sum(times / (back + 2.0::double)), 6) as strength from w group by 1, 2), best as (select * from co where strength >= 0.1 qualify row_number() over (partition by document_id order by strength desc, partner_id) <= 50)"""


@query(f"with {SEQ} select next_id, score from q")
def next_document_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return predict.sequence_scores(T.access_log(spark, sf), USER)


@query(f"with {A}, {CO} select document_id, partner_id, strength from best")
def cooccurrence_top(spark: SparkSession, sf: str) -> DataFrame:
    return predict.cooccurrence(T.access_log(spark, sf))


@query(f"with {SEQ}, {CO}, u as (select next_id as id from (select * from q order by score desc, next_id limit 5) union select partner_id from (select * from best where document_id = {USER} order by strength desc, partner_id limit 10)) select id as document_id from u where id <> {USER} order by id limit 10")
def predicted_documents(spark: SparkSession, sf: str) -> DataFrame:
    return predict.predicted(T.access_log(spark, sf), USER, 10)


@query(f"with {O} select txn_id, count(*) as n_ops from o group by 1")
def streaming_commit(spark: SparkSession, sf: str) -> DataFrame:
    """The log arrives as files, one of them twice; what the committed table then holds."""
    return commits.replayed(T.operations(spark, sf)).groupBy("txn_id").agg(F.count(F.lit(1)).alias("n_ops"))
