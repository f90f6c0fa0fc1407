"""Pair mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import mapping as M
from lexmill.operators.stored import stored

from .registry import query, table

COS = "greatest(-1.0, least(1.0, list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))))"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as spans: an image is 20 of them."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 20).alias("image_id"), F.col("vec_id").alias("span_id"), (F.col("vec_id") % 5).alias("caption_id"), (F.col("label") % 3).alias("role"), (F.col("label") % 2).alias("entity_id"), "embedding", (0.5 + (F.col("vec_id") % 7) / 16).alias("confidence"))


SPANS = "(SELECT vec_id // 20 AS image_id, vec_id AS span_id, vec_id % 5 AS caption_id, label % 3 AS role, label % 2 AS entity_id, embedding, 0.5::DOUBLE + (vec_id % 7) / 16.0::DOUBLE AS confidence FROM embeddings)"
EVAL = f"""(SELECT image_id, a, b, cosine, score, CASE WHEN ca = cb THEN 'same_caption' WHEN ra <> rb THEN 'role' WHEN ea <> eb THEN 'entity' WHEN ra = 2 OR rb = 2 THEN 'protected' WHEN against >= 0.5 THEN 'contradiction' WHEN cosine < 0.1 THEN 'cosine' WHEN score < 0.3 THEN 'score' END AS rejected
FROM (SELECT *, round(0.7::DOUBLE * c + 0.1::DOUBLE * (ra = rb)::INT + 0.2::DOUBLE * (ea = eb)::INT - 0.5::DOUBLE * against, 6) AS score, round(c, 6) AS cosine
FROM (SELECT x.image_id, x.span_id AS a, y.span_id AS b, x.caption_id AS ca, y.caption_id AS cb, x.role AS ra, y.role AS rb, x.entity_id AS ea, y.entity_id AS eb, CASE WHEN (x.span_id + y.span_id) % 11 = 0 THEN 0.25::DOUBLE + (x.span_id % 4) / 4.0::DOUBLE ELSE 0.0::DOUBLE END AS against, {COS.format('x.embedding', 'y.embedding')} AS c
FROM {SPANS} x JOIN {SPANS} y ON x.image_id = y.image_id AND x.span_id < y.span_id)))"""


def _contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an image whose ids add up to a multiple of 11, of some strength."""
    s = _spans(spark, sf_dir).select("image_id", "span_id")
    pairs = s.select("image_id", F.col("span_id").alias("a")).join(s.select("image_id", F.col("span_id").alias("b")), "image_id").filter("a < b AND (a + b) % 11 = 0")
    return pairs.withColumn("strength", 0.25 + (F.col("a") % 4) / 4.0)


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evaluated(_spans(spark, sf_dir), 0.1, 0.3, _contradictions(spark, sf_dir), protected=(2,))


@query(f"SELECT vec_id, round({COS.format('embedding', 'list_reverse(embedding)')}, 6) AS cosine FROM embeddings")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(M.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine"))


@query(f"SELECT * FROM {EVAL}")
def pair_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    pairs = _evaluated(spark, sf_dir).select("image_id", "a", "b", "score", F.col("rejected").isNull().alias("ok"))
    return M.complete_link(spans.select("image_id", F.col("span_id").alias("node")), pairs, "image_id", 4)


@query()
def complete_link_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


@query()
def consensus_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.consensus(_clusters(spark, sf_dir), _spans(spark, sf_dir), 5, 0.4)


@query()
def sparse_candidate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    return M.sparse_clusters(s.select("image_id", F.col("span_id").alias("node"), F.col("confidence").alias("mass"), "embedding"), "image_id", 0.8, 0.1)


@query("""WITH n AS (SELECT conv_id AS example_id, turn AS span_id, role AS label FROM conversations),
e AS (SELECT conv_id AS example_id, turn AS s, 'next' AS relation, turn + 1 AS t FROM conversations x WHERE EXISTS (SELECT 1 FROM conversations y WHERE y.conv_id = x.conv_id AND y.turn = x.turn + 1)),
i AS (SELECT e.example_id, s AS span_id, 'out:next:' || n.label AS x FROM e JOIN n ON n.example_id = e.example_id AND n.span_id = t UNION ALL SELECT e.example_id, t, 'in:next:' || n.label FROM e JOIN n ON n.example_id = e.example_id AND n.span_id = s)
SELECT n.example_id, n.span_id, coalesce(string_agg(x, '|' ORDER BY x), '') AS signature FROM n LEFT JOIN i ON n.example_id = i.example_id AND n.span_id = i.span_id GROUP BY ALL""")
def relation_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    nodes = c.select(F.col("conv_id").alias("example_id"), F.col("turn").alias("span_id"), F.col("role").alias("label"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = c.join(after, ["conv_id", "turn"]).select(F.col("conv_id").alias("example_id"), F.col("turn").alias("source"), F.lit("next").alias("relation"), (F.col("turn") + 1).alias("target"))
    return M.signatures(nodes, edges)


@query(f"""SELECT a, b, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS r
FROM (SELECT x.vec_id AS a, y.vec_id AS b, {COS.format('x.embedding', 'y.embedding')} AS c FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id AND x.vec_id % 50 = 0)) WHERE r <= 5""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, against all others."""
    e = table(spark, sf_dir, "embeddings")
    return M.nearest(e.filter("vec_id % 50 = 0"), e, 5)


FEATURES = "(SELECT item_id AS id, feature, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS feature FROM benchmark) GROUP BY ALL)"
JACCARD = f"""(WITH f AS {FEATURES}, t AS (SELECT id, sum(n) AS t FROM f GROUP BY id), m AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS m FROM f x JOIN f y ON x.feature = y.feature AND x.id < y.id GROUP BY ALL)
SELECT a, b, round(m::DOUBLE / (ta.t + tb.t - m)::DOUBLE, 6) AS similarity FROM m JOIN t ta ON ta.id = a JOIN t tb ON tb.id = b)"""


def _jaccard(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("feature"))
    return M.weighted_jaccard(b.groupBy("id", "feature").agg(F.count("*").alias("n")), least)


@query(f"SELECT * FROM {JACCARD} WHERE similarity >= 0.02")
def weighted_jaccard_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard(spark, sf_dir, 0.02)


@query(f"""WITH RECURSIVE c AS (SELECT a, b, similarity, row_number() OVER (ORDER BY similarity DESC, a, b) AS k FROM {JACCARD}), r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, false AS taken UNION ALL
SELECT c.k, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE used || [a, b] END, NOT (list_contains(used, a) OR list_contains(used, b)) FROM r JOIN c ON c.k = r.k + 1)
SELECT a, b, similarity FROM r JOIN c USING (k) WHERE taken""")
def disjoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.disjoint_pairs(_jaccard(spark, sf_dir, 0.0), "similarity", stored)


@query("""SELECT label, i, round(x, 6) AS x FROM (SELECT label, i, avg(v::DOUBLE) AS x FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY ALL)""")
def fusion_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(M.fused(table(spark, sf_dir, "embeddings"), "label"))


def _flat(f: DataFrame) -> DataFrame:
    return f.select("label", F.posexplode("fused").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("""WITH e AS (SELECT label, i, v::DOUBLE AS v, n FROM (SELECT label, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings)),
m AS (SELECT label, i, avg(v) AS x, avg(n) AS n FROM e GROUP BY ALL), s AS (SELECT label, sqrt(sum(x * x)) AS own FROM m GROUP BY label)
SELECT m.label, i, round(x * n / own, 6) AS x FROM m JOIN s ON m.label = s.label""")
def fusion_norm_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(M.fused(table(spark, sf_dir, "embeddings"), "label", keep_norm=True))


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(text, '[^ ]+') AS a FROM conversations), b AS (SELECT id, a, list_concat(list_concat(a[1:1], ['changed']), a[3:]) AS b FROM c)
SELECT id, 1 AS slot, a[2] AS one, 'changed' AS other FROM b WHERE len(a) > 2 AND a[2] <> 'changed'""")
def one_slot_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("a"))
    return M.one_slot(c.withColumn("b", F.concat(F.slice("a", 1, 1), F.array(F.lit("changed")), F.slice("a", 3, 1 << 30))))


PAIRED = "(SELECT x.vec_id AS a, y.vec_id AS b, {} AS c FROM embeddings x JOIN embeddings y ON y.vec_id BETWEEN x.vec_id + 1 AND x.vec_id + 5 WHERE {})"


@query(f"""WITH p AS (SELECT a, b FROM {PAIRED.format(COS.format('x.embedding', 'y.embedding'), 'true')} WHERE round(c, 6) >= 0.1), e AS (SELECT a, b FROM {PAIRED.format('0', 'x.label = y.label')}), f AS (SELECT a, b FROM {PAIRED.format('0', 'x.label % 2 <> y.label % 2')}),
n AS (SELECT (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM p JOIN e USING (a, b)) AS hits, (SELECT count(*) FROM p JOIN f USING (a, b)) AS false_merges)
SELECT *, round(CASE WHEN predicted > 0 THEN hits / predicted ELSE 1.0 END, 6) AS precision, round(CASE WHEN expected > 0 THEN hits / expected ELSE 1.0 END, 6) AS recall FROM n""")
def mapping_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near vectors among neighbours, against those with one label, and those whose labels must not meet."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select(F.col("vec_id").alias("a"), F.col("label").alias("la"), F.col("embedding").alias("x"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 5)).alias("b"))
    pairs = x.join(e.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), F.col("embedding").alias("y")), "b")
    near = pairs.filter(F.round(M.cosine(F.col("x"), F.col("y")), 6) >= 0.1)
    return M.pair_quality(near, pairs.filter("la = lb"), pairs.filter("la % 2 <> lb % 2"))


#: Turns as spans: a cluster holds the first turn of each conversation with one role and length class.
TURNS = "(SELECT conv_id AS example, conv_id * 1000 + turn AS span, turn AS start, role = 'system' AS protected, role || length(text) % 4 AS cluster FROM conversations)"
BATCHES = f"""s AS {TURNS}, m AS (SELECT example, cluster, min(span) AS span, arg_min(start, span) AS start, arg_min(protected, span) AS protected FROM s GROUP BY ALL),
n AS (SELECT example, count(*) FILTER (NOT protected) AS n FROM s GROUP BY example),
p AS (SELECT a.example AS a, b.example AS b, list(a.cluster ORDER BY a.start) AS one, list(a.cluster ORDER BY b.start) AS other, count(*) AS n_aligned, count(*) FILTER (NOT a.protected OR NOT b.protected) AS content FROM m a JOIN m b ON a.cluster = b.cluster AND a.example < b.example GROUP BY ALL),
q AS (SELECT a, b, n_aligned, CASE WHEN greatest(x.n, y.n) > 0 THEN content / greatest(x.n, y.n) ELSE 0.0 END AS coverage FROM p JOIN n x ON x.example = a JOIN n y ON y.example = b WHERE one = other),
c AS (SELECT a, b, n_aligned, round(coverage, 6) AS coverage, row_number() OVER (ORDER BY round(coverage, 6) DESC, n_aligned DESC, a, b) AS k FROM q WHERE n_aligned >= 2 AND coverage >= 0.5)"""


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "conversations")
    t = t.select(F.col("conv_id").alias("example"), (F.col("conv_id") * 1000 + F.col("turn")).alias("span"), F.col("turn").alias("start"), F.col("turn").alias("end"), (F.col("role") == "system").alias("protected"), F.concat("role", (F.length("text") % 4).cast("string")).alias("cluster"))
    return t.drop("cluster"), t.groupBy("example", "cluster").agg(F.min("span").alias("node")).select("node", "cluster")


@query(f"WITH {BATCHES} SELECT a, b, n_aligned, coverage FROM c")
def aligned_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.aligned_examples(*_turns(spark, sf_dir), least_coverage=0.5)


@query(f"""WITH RECURSIVE {BATCHES}, r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, false AS taken UNION ALL
SELECT c.k, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE used || [a, b] END, NOT (list_contains(used, a) OR list_contains(used, b)) FROM r JOIN c ON c.k = r.k + 1)
SELECT a, b, n_aligned, coverage FROM r JOIN c USING (k) WHERE taken""")
def superbatch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.superbatches(*_turns(spark, sf_dir), stored, 0.5)


#: Vectors as spans of examples of ten; neighbouring examples may be joined.
NODES = """(SELECT vec_id AS span, vec_id // 10 AS example, vec_id % 13 = 0 AS protected, [vec_id % 26] AS source, CASE WHEN vec_id % 9 = 0 THEN 'DATE' WHEN vec_id % 9 < 5 THEN 'thing' END AS entity,
CASE WHEN vec_id % 4 > 0 THEN 'g' || vec_id % 2 END AS grammatical, CASE WHEN vec_id % 5 > 0 THEN 'r' || vec_id % 2 END AS role, NULL::VARCHAR AS value, 'b' || vec_id % 17 // 16 AS binding, 's' || label % 5 // 3 AS signature, embedding FROM embeddings)"""


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("vec_id")
    n = table(spark, sf_dir, "embeddings").select(
        i.alias("span"), F.floor(i / 10).alias("example"), (i % 13 == 0).alias("protected"), F.array(i % 26).alias("source"), F.when(i % 9 == 0, "DATE").when(i % 9 < 5, "thing").alias("entity"),
        F.when(i % 4 > 0, F.concat(F.lit("g"), (i % 2).cast("string"))).alias("grammatical"), F.when(i % 5 > 0, F.concat(F.lit("r"), (i % 2).cast("string"))).alias("role"), F.lit(None).cast("string").alias("value"),
        F.concat(F.lit("b"), F.floor(i % 17 / 16).cast("string")).alias("binding"), F.concat(F.lit("s"), F.floor(F.col("label") % 5 / 3).cast("string")).alias("signature"), "embedding")
    e = n.select(F.col("example").alias("left")).distinct()
    return n, e.select("left", (F.col("left") + 1).alias("right")).unionByName(e.select("left", F.col("left").alias("right")))


@query(f"""WITH n AS {NODES}, e AS (SELECT DISTINCT example FROM n), p AS (SELECT example AS l, example + 1 AS r FROM e UNION ALL SELECT example, example FROM e)
SELECT a, b, CASE WHEN exact THEN 1.0 ELSE round(c, 6) END AS cosine, CASE WHEN same_example THEN 'same_example' WHEN guarded AND NOT exact THEN 'protected_span' WHEN named AND NOT same THEN 'protected_entity_identity'
WHEN g THEN 'grammatical_role_mismatch' WHEN ro THEN 'semantic_role_mismatch' WHEN en THEN 'entity_type_mismatch' WHEN bi THEN 'binding_type_mismatch' WHEN si THEN 'relation_signature_mismatch'
WHEN CASE WHEN exact THEN 1.0 ELSE round(c, 6) END < 0.1 THEN 'cosine_below_threshold' ELSE 'compatible' END AS reason
FROM (SELECT x.span AS a, y.span AS b, x.example = y.example AS same_example, x.source = y.source AS same, x.protected OR y.protected AS guarded, x.protected AND y.protected AND x.source = y.source AS exact,
      coalesce(x.entity = 'DATE', false) OR coalesce(y.entity = 'DATE', false) AS named, coalesce(x.grammatical <> y.grammatical, false) AS g, coalesce(x.role <> y.role, false) AS ro, coalesce(x.entity <> y.entity, false) AS en, x.binding <> y.binding AS bi, x.signature <> y.signature AS si,
      {COS.format('x.embedding', 'y.embedding')} AS c FROM p JOIN n x ON x.example = l JOIN n y ON y.example = r WHERE l <> r OR x.span < y.span)""")
def span_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.decided(*_nodes(spark, sf_dir), 0.1)


@query()
def span_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against a direct version in tests."""
    return M.example_clusters(M.decided(*_nodes(spark, sf_dir), 0.1), 4, stored)


#: Units: every third span of an image with one role is a group.
@query(f"""WITH s AS (SELECT *, span_id % 3 AS order_class, CASE WHEN span_id % 7 = 0 THEN 'separator' ELSE 'unique' END AS kind FROM {SPANS}),
g AS (SELECT image_id, span_id, min(span_id) OVER (PARTITION BY image_id, role) AS cluster FROM s WHERE span_id % 3 = 0),
m AS (SELECT s.*, g.cluster IS NOT NULL AS joint, coalesce(cluster, s.span_id) AS key, CASE WHEN g.cluster IS NULL THEN kind ELSE 'consensus' END AS own FROM s LEFT JOIN g USING (image_id, span_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY order_class, first, role) - 1 AS unit_id FROM (SELECT image_id, joint, key, own AS kind, min(order_class) AS order_class, min(span_id) AS first, arg_min(role, span_id) AS role FROM m GROUP BY ALL)),
h AS (SELECT m.image_id, m.span_id, m.role, u.unit_id FROM m JOIN u ON u.image_id = m.image_id AND u.joint = m.joint AND u.key = m.key),
c AS (SELECT a.image_id, a.span_id AS x, b.span_id AS y, least(a.unit_id, b.unit_id) AS p, greatest(a.unit_id, b.unit_id) AS q, CASE WHEN a.role = b.role THEN a.role END AS role FROM h a JOIN h b ON a.image_id = b.image_id AND a.span_id < b.span_id
      WHERE (a.span_id + b.span_id) % 11 = 0 AND 0.25 + (a.span_id % 4) / 4.0 >= 0.5 AND a.unit_id <> b.unit_id),
d AS (SELECT image_id, p, q, min(x * 1000000 + y) AS place, arg_min(x, x * 1000000 + y) AS first FROM c GROUP BY ALL)
SELECT image_id, unit_id, kind, order_class, first, '' AS alternatives FROM u
UNION ALL SELECT d.image_id, (SELECT count(*) FROM u WHERE u.image_id = d.image_id) + row_number() OVER (PARTITION BY d.image_id ORDER BY place) - 1, 'uncertainty', 2, first, p || ',' || q FROM d""")
def ordered_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir).withColumns({"order_class": F.col("span_id") % 3, "kind": F.when(F.col("span_id") % 7 == 0, "separator").otherwise("unique")})
    from pyspark.sql import Window as W

    g = s.filter("span_id % 3 = 0").select("image_id", F.col("span_id").alias("node"), F.min("span_id").over(W.partitionBy("image_id", "role")).alias("cluster"))
    u = M.units(s, g, _contradictions(spark, sf_dir))
    return u.select("image_id", "unit_id", "kind", "order_class", "first", F.concat_ws(",", F.transform("alternatives", lambda x: x.cast("string"))).alias("alternatives"))


@query("""SELECT conv_id, feature, count(*) AS n FROM (SELECT conv_id, 'node:' || role AS feature FROM conversations UNION ALL
SELECT x.conv_id, 'edge:' || x.role || '>' || y.role FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1) GROUP BY ALL""")
def structural_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("then"))
    f = c.select("conv_id", F.concat(F.lit("node:"), "role").alias("feature")).unionByName(c.join(after, ["conv_id", "turn"]).select("conv_id", F.concat(F.lit("edge:"), "role", F.lit(">"), "then").alias("feature")))
    return f.groupBy("conv_id", "feature").agg(F.count("*").alias("n"))
