"""Queries of rows: selection, stacking, sampling, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import rng, vec
from quillon.operators import frame, preproc, sample

from .registry import ENTRIES, VECTORS, query, r6, table, uniform, vectors


@query("SELECT doc_id FROM labels WHERE toxic = 1")
def select_eq(spark, d):
    return frame.select_value(table(spark, d, "labels"), "toxic", 1, "doc_id")


@query("SELECT doc_id FROM labels WHERE quality = toxic")
def select_equal_cols(spark, d):
    return frame.select_equal(table(spark, d, "labels"), "quality", "toxic", "doc_id")


@query("SELECT doc_id FROM labels WHERE quality <> toxic")
def select_not_equal_cols(spark, d):
    return frame.select_not_equal(table(spark, d, "labels"), "quality", "toxic", "doc_id")


@query("SELECT p_partkey - (SELECT count(*) - 150 FROM part) AS row_id, p_name FROM part WHERE p_partkey >= (SELECT count(*) - 150 FROM part) AND p_partkey < (SELECT count(*) - 50 FROM part)")
def slice_rows(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), "p_name")
    return frame.slice_rows(p, -150, 100)


@query("SELECT i.p_partkey AS row_id, p.p_name, p.p_size FROM part i JOIN part p ON p.p_partkey = (i.p_partkey * 7) // 3 % (SELECT count(*) FROM part)")
def gather_rows(spark, d):
    p = table(spark, d, "part")
    n = p.count()
    index = p.select(F.col("p_partkey").alias("pos"), (F.floor(F.col("p_partkey") * 7 / 3) % n).alias("row_id"))
    return frame.gather(p.select(F.col("p_partkey").alias("row_id"), "p_name", "p_size"), index)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40)")
def exclude_rows(spark, d):
    index = table(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    return frame.exclude_rows(table(spark, d, "part"), index, "p_partkey").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 25 AND p_brand = 'Brand#11')")
def mask_rows(spark, d):
    return frame.mask_rows(table(spark, d, "part"), ~((F.col("p_size") > 25) & (F.col("p_brand") == "Brand#11"))).select("p_partkey", "p_size")


@query(f"SELECT vec_id AS row_id, label FROM embeddings WHERE {uniform('vec_id // 10', 3)} < 0.5")
def group_select(spark, d):
    v = vectors(spark, d).select("row_id", "label")
    chain = v.select(F.floor(F.col("row_id") / 10).alias("g")).distinct().select("g", F.when(rng.uniform(F.col("g"), 3) < 0.5, 1).otherwise(0).alias("bit"))
    return frame.group_select(v, chain, 10)


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09) AS mask FROM part")
def create_mask(spark, d):
    index = table(spark, d, "lineitem").where("l_discount >= 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return frame.create_mask(table(spark, d, "part"), index, "p_partkey")


@query(f"""WITH s AS (SELECT row_id, label, list_transform(features, lambda x: exp(x - list_max(features))) AS e FROM {VECTORS}),
p AS (SELECT row_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s),
v AS (SELECT row_id, label, list_var_pop(p) * 64 / 63 AS value FROM p)
SELECT row_id, label, round(value, 9) AS value FROM v a WHERE EXISTS (SELECT 1 FROM v b WHERE b.row_id < 30 AND b.label = a.label AND abs(a.value - b.value) <= 0.0000002)""")
def variance_window_select(spark, d):
    v = vectors(spark, d).select("row_id", "label", vec.variance(vec.softmax(F.col("features")), population=False).alias("value"))
    points = v.where("row_id < 30").select("label", F.col("value").alias("p"))
    return frame.window_select(v, points, 0.0000002).select("row_id", "label", F.round("value", 9).alias("value"))


@query(f"""WITH s AS (SELECT row_id, label, list_transform(features, lambda x: exp(x - list_max(features))) AS e FROM {VECTORS}),
p AS (SELECT row_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s),
v AS (SELECT row_id, label, list_var_pop(p) * 64 / 63 AS value FROM p)
SELECT row_id, label, round(value, 9) AS value FROM v a WHERE EXISTS (SELECT 1 FROM v b WHERE b.row_id % 20 = 0 AND b.label = a.label AND abs(a.value - b.value) <= 0.0000002)""")
def variance_window_select_all(spark, d):
    """Points from the whole table."""
    v = vectors(spark, d).select("row_id", "label", vec.variance(vec.softmax(F.col("features")), population=False).alias("value"))
    points = v.where("row_id % 20 = 0").select("label", F.col("value").alias("p"))
    return frame.window_select(v, points, 0.0000002).select("row_id", "label", F.round("value", 9).alias("value"))


@query(f"SELECT row_id, (generate_subscripts(f, 1) - 1)::INTEGER AS j, round(unnest(f), 6) + 0.0 AS v FROM (SELECT row_id, list_concat(features, list_transform(features, lambda x: x * x)) AS f FROM {VECTORS})")
def hstack(spark, d):
    v = vectors(spark, d).select("row_id", "features")
    both = frame.hstack(v, v.withColumn("features", vec.squared(F.col("features"))))
    return both.select("row_id", F.posexplode("features").alias("j", "v")).withColumn("v", r6("v"))


@query("SELECT s_suppkey AS row_id, s_acctbal AS bal FROM supplier UNION ALL SELECT c_custkey + (SELECT count(*) FROM supplier), c_acctbal FROM customer")
def vstack(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("bal"))
    return frame.vstack(s, table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("bal")))


@query("SELECT p_partkey, p_brand, p_type, p_size FROM part")
def drop_columns(spark, d):
    return frame.drop_columns(table(spark, d, "part"), [1, -1])


@query(f"SELECT row_id, (generate_subscripts(f, 1) - 1)::INTEGER AS j, round(unnest(f), 6) + 0.0 AS v FROM (SELECT row_id, list_concat(features[2:3], features[5:63]) AS f FROM {VECTORS})")
def drop_features(spark, d):
    return vectors(spark, d).select("row_id", F.posexplode(vec.drop_elements(F.col("features"), [0, 3, -1], 64)).alias("j", "v")).withColumn("v", r6("v"))


@query("SELECT CASE p_partkey WHEN 3 THEN 11 WHEN 11 THEN 3 ELSE p_partkey END AS row_id, p_name FROM part")
def swap_rows(spark, d):
    return frame.swap_rows(table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), "p_name"), 3, 11)


@query('SELECT event_type AS value, min(event_id) AS "first" FROM events GROUP BY event_type')
def uniques(spark, d):
    return frame.uniques(table(spark, d, "events"), "event_type", "event_id")


@query("SELECT coalesce((SELECT min(event_id) FROM events WHERE event_type = 'purchase' AND event_id >= 100), -1) AS \"first\", coalesce((SELECT max(event_id) FROM events WHERE event_type = 'purchase'), -1) AS \"last\", -1::BIGINT AS \"none\"")
def find_first_last(spark, d):
    e = table(spark, d, "events")
    hit = F.col("event_type") == "purchase"
    first, last = frame.find_first(e, hit, "event_id", 100), frame.find_last(e, hit, "event_id")
    none = frame.find_first(e, F.col("event_type") == "no such", "event_id").withColumnRenamed("first", "none")
    return first.crossJoin(last).crossJoin(none.select(F.col("none").cast("long").alias("none")))


_SHUFFLED = "SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey || ':7'), p_partkey) - 1 AS pos FROM part"


@query(_SHUFFLED)
def shuffle(spark, d):
    return sample.shuffled(table(spark, d, "part").select("p_partkey"), "p_partkey", 7)


@query("SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY md5(p_partkey || ':7'), p_partkey) - 1) * 4 + p_partkey % 4 AS pos FROM part")
def shuffle_groups(spark, d):
    return sample.shuffle_between_groups(table(spark, d, "part").select("p_partkey"), 4, "p_partkey", 7)


@query(f"SELECT p_partkey, pos, pos < greatest(1, floor((SELECT count(*) FROM part) * 0.7)) AS is_train FROM ({_SHUFFLED})")
def train_test_split(spark, d):
    return sample.split(sample.shuffled(table(spark, d, "part").select("p_partkey"), "p_partkey", 7), 0.7)


@query(f"WITH n AS (SELECT count(*) // 7 AS s FROM part) SELECT p_partkey, pos, CASE WHEN pos // s < 7 THEN pos // s ELSE -1 END AS fold FROM ({_SHUFFLED}), n")
def k_fold(spark, d):
    return sample.k_fold(sample.shuffled(table(spark, d, "part").select("p_partkey"), "p_partkey", 7), 7)


@query("WITH n AS (SELECT greatest(1, count(*) // 64) - 1 AS m FROM events) SELECT event_id, least(event_id // 64, m) AS batch FROM events, n")
def minibatch(spark, d):
    e = table(spark, d, "events").select("event_id")
    return sample.mini_batches(e, 64, "event_id")


_MM = "WITH a AS (SELECT min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) p0, max(l_extendedprice) p1, avg(l_quantity) qm, stddev_pop(l_quantity) qs, avg(l_extendedprice) pm, stddev_pop(l_extendedprice) ps FROM lineitem) "
_LINE = ["l_quantity", "l_extendedprice"]


def _scaled(spark, d, scaler, back=False):
    df = table(spark, d, "lineitem").select("l_orderkey", *_LINE)
    out = scaler(df).transform(df)
    out = scaler(df).inverse(out) if back else out
    return out.select("l_orderkey", *(r6(c).alias(c) for c in _LINE))


@query(_MM + "SELECT l_orderkey, round((l_quantity - q0) / nullif(q1 - q0, 0), 6) + 0.0 AS l_quantity, round((l_extendedprice - p0) / nullif(p1 - p0, 0), 6) + 0.0 AS l_extendedprice FROM lineitem, a")
def minmax(spark, d):
    return _scaled(spark, d, lambda df: preproc.min_max(df, _LINE))


@query(_MM + "SELECT l_orderkey, round((l_quantity - q0) / nullif(q1 - q0, 0) * 2 - 1, 6) + 0.0 AS l_quantity, round((l_extendedprice - p0) / nullif(p1 - p0, 0) * 2 - 1, 6) + 0.0 AS l_extendedprice FROM lineitem, a")
def minmax_sym(spark, d):
    return _scaled(spark, d, lambda df: preproc.min_max(df, _LINE, symmetric=True))


@query("SELECT l_orderkey, round(l_quantity, 6) + 0.0 AS l_quantity, round(l_extendedprice, 6) + 0.0 AS l_extendedprice FROM lineitem")
def minmax_inverse(spark, d):
    return _scaled(spark, d, lambda df: preproc.min_max(df, _LINE), back=True)


@query(_MM + "SELECT l_orderkey, round((l_quantity - qm) / nullif(qs, 0), 6) + 0.0 AS l_quantity, round((l_extendedprice - pm) / nullif(ps, 0), 6) + 0.0 AS l_extendedprice FROM lineitem, a")
def standardize(spark, d):
    return _scaled(spark, d, lambda df: preproc.standard(df, _LINE))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 1 ELSE -1 END AS sign FROM labels")
def binary_conv(spark, d):
    return table(spark, d, "labels").select("doc_id", preproc.binary(F.col("toxic"), 1).alias("sign"))


_CODES = "WITH f AS (SELECT event_type AS t, min(event_id) AS m FROM events GROUP BY 1), c AS (SELECT t, row_number() OVER (ORDER BY m) AS code FROM f) "


@query(_CODES + "SELECT event_id, code FROM events JOIN c ON t = event_type")
def string_encode(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return preproc.StringEncoder.fit(e, "event_type", "event_id", 1).encode(e, "event_type").select("event_id", "code")


@query('SELECT event_id, event_type AS "value" FROM events')
def string_decode(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    codes = preproc.StringEncoder.fit(e, "event_type", "event_id", 1)
    return codes.decode(codes.encode(e, "event_type"), "code").select("event_id", "value")


def _onehot(spark, d, drop_first):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    enc = preproc.OneHot.fit(c, "c_mktsegment", drop_first)
    v = enc.encode(F.col("c_mktsegment"))
    return c.select("c_custkey", F.array_join(v.cast("array<string>"), "").alias("bits"), enc.decode(v).alias("back"))


_CATS = "WITH c AS (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS s FROM customer) SELECT c_custkey, list_aggregate(list_transform({0}, lambda x: CASE WHEN x = c_mktsegment THEN '1' ELSE '0' END), 'string_agg', '') AS bits, c_mktsegment AS back FROM customer, c"


@query(_CATS.format("s"))
def onehot(spark, d):
    return _onehot(spark, d, False)


@query(_CATS.format("s[2:]"))
def onehot_drop_first(spark, d):
    return _onehot(spark, d, True)


@query(f"SELECT row_id, (generate_subscripts(features, 1) - 1)::INTEGER AS j, round(unnest(features) / 255 - 0.5, 6) + 0.0 AS v FROM {VECTORS}")
def pixel_scale(spark, d):
    return vectors(spark, d).select("row_id", F.posexplode(preproc.pixels(F.col("features"))).alias("j", "v")).withColumn("v", r6("v"))


@query("""WITH k AS (SELECT ('0x' || substr(md5('0:5'), 1, 8))::BIGINT % (SELECT count(*) FROM events) AS k)
SELECT coalesce(min(event_id) FILTER (event_type = 'purchase' AND event_id >= k), max(event_id) FILTER (event_type = 'purchase' AND event_id < k), -1) AS found FROM events, k""")
def find_random(spark, d):
    e = table(spark, d, "events")
    return frame.find_random(e, F.col("event_type") == "purchase", e.count(), "event_id", 5)


@query("SELECT row_number() OVER (ORDER BY p_size % 3, p_partkey) - 1 AS row_id, p_name FROM part")
def rearrange(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), "p_name", "p_size")
    return frame.rearrange(p.select("row_id", "p_name"), p.select((F.col("p_size") % 3).alias("part"), F.col("row_id").alias("pos"), "row_id"))


@query(f"SELECT (j // 8)::BIGINT AS y, (j % 8)::BIGINT AS x, round(sum(v), 6) + 0.0 AS v FROM {ENTRIES} GROUP BY 1, 2")
def cube_sum(spark, d):
    e = frame.entries(vectors(spark, d)).select(F.col("i").alias("z"), F.floor(F.col("j") / 8).alias("y"), (F.col("j") % 8).cast("long").alias("x"), "v")
    return frame.cube_sum(e).withColumn("v", r6("v"))
