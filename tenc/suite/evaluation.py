"""Queries over splits, metrics, class weights, neighbours, similarity and drawn categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.functions import similarity as S
from tenc.functions.hashing import MODEL_SEED, SPLIT_SEED
from tenc.operators import metrics, neighbours, profile, synth
from tenc.operators.encoders.stats import MULTICLASS, REGRESSION
from tenc.operators.similarity import ball_by_value, ball_counts
from tenc.operators.splits import (
    fold_target_stats,
    plan_shuffle_split,
    shuffle_split,
    stratified_split,
)
from tenc.operators.weights import add_class_weights
from tenc.session import materialise
from tenc.suite.bases import (
    RETURNS_SQL,
    digest_sql,
    returns,
    rounded,
    table,
    uniform_sql,
)
from tenc.suite.registry import query

_FOLDS = 5

_SPLIT_SQL = f"""
folds AS (SELECT unnest(range({_FOLDS}))::INTEGER AS fold),
split AS (
  SELECT fold, o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice,
         row_number() OVER (PARTITION BY fold ORDER BY {digest_sql("o_orderkey", SPLIT_SEED, "fold")})
           <= ceil(count(*) OVER (PARTITION BY fold) / 3.0::DOUBLE - 1e-9) AS is_test
  FROM orders CROSS JOIN folds)"""


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"
    )


@query("shuffle_split", f"WITH {_SPLIT_SQL} SELECT fold, o_orderkey, is_test FROM split")
def shuffle_split_query(spark: SparkSession, folder: str) -> DataFrame:
    split = shuffle_split(_orders(spark, folder), "o_orderkey", _FOLDS)
    return split.select("fold", "o_orderkey", "is_test")


@query(
    "stratified_split",
    f"""
WITH folds AS (SELECT unnest(range({_FOLDS}))::INTEGER AS fold),
c AS (SELECT o_orderstatus AS class, count(*) AS n,
             sum(count(*)) OVER () AS total FROM orders GROUP BY 1),
t AS (SELECT *, total - ceil(total / 3.0::DOUBLE - 1e-9)::BIGINT AS n_train FROM c),
w AS (SELECT *, n * n_train // total AS whole, n * n_train % total AS part FROM t),
sizes AS (
  SELECT class, n - whole - CASE WHEN row_number() OVER (ORDER BY part DESC, class)
                                      <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END AS take
  FROM w)
SELECT fold, o_orderkey,
       row_number() OVER (PARTITION BY fold, o_orderstatus
                          ORDER BY {digest_sql("o_orderkey", SPLIT_SEED, "fold")}) <= take AS is_test
FROM orders CROSS JOIN folds JOIN sizes ON o_orderstatus = class""",
)
def stratified_split_query(spark: SparkSession, folder: str) -> DataFrame:
    orders = _orders(spark, folder)
    split = stratified_split(orders, "o_orderkey", "o_orderstatus", _FOLDS)
    return split.select("fold", "o_orderkey", "is_test")


_FOLD_ENCODING_SQL = f"""
{_SPLIT_SQL},
train AS (SELECT fold, o_custkey AS category, count(*) AS n, avg(o_totalprice) AS mean
          FROM split WHERE NOT is_test GROUP BY 1, 2),
totals AS (SELECT fold, count(*) AS n_rows, avg(o_totalprice) AS prior,
                  count(DISTINCT o_custkey) AS k FROM split WHERE NOT is_test GROUP BY 1),
encoded AS (SELECT fold, category, n, (n * mean + prior * n_rows / k::DOUBLE)
                   / (n + n_rows / k::DOUBLE) AS enc FROM train JOIN totals USING (fold))"""


def _fold_encoding(df: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Encodings and priors of all folds at once."""
    stats = materialise(fold_target_stats(df, test, "o_custkey", "o_totalprice", _FOLDS))
    totals = stats.groupBy("fold").agg(
        F.sum("n").alias("_rows"),
        F.count("category").alias("_k"),
        (F.sum("s") / F.sum("n")).alias("prior"),
    )
    m = F.col("_rows") / F.col("_k")
    encoded = stats.join(F.broadcast(totals), "fold").select(
        "fold", "category", "n", ((F.col("s") + F.col("prior") * m) / (F.col("n") + m)).alias("enc")
    )
    return encoded, totals


@query(
    "fold_target_encode",
    f"WITH {_FOLD_ENCODING_SQL} "
    "SELECT fold, category::VARCHAR AS category, n, enc::FLOAT::DOUBLE AS enc FROM encoded",
)
def fold_target_encode(spark: SparkSession, folder: str) -> DataFrame:
    df = _orders(spark, folder)
    test = plan_shuffle_split(df, "o_orderkey", _FOLDS).test_rows(df)
    encoded, _ = _fold_encoding(df, test)
    return encoded.withColumn("enc", F.col("enc").cast("float").cast("double"))


@query(
    "metric_r2",
    f"""
WITH {_FOLD_ENCODING_SQL},
scored AS (SELECT s.fold, o_totalprice AS y, coalesce(enc, prior) AS p
           FROM split s JOIN totals USING (fold)
           LEFT JOIN encoded e ON s.fold = e.fold AND s.o_custkey = e.category WHERE is_test),
means AS (SELECT fold, avg(y) AS mean FROM scored GROUP BY 1)
SELECT fold, round(1 - sum((y - p) * (y - p)) / sum((y - mean) * (y - mean)), 6) AS score
FROM scored JOIN means USING (fold) GROUP BY 1""",
)
def metric_r2(spark: SparkSession, folder: str) -> DataFrame:
    df = _orders(spark, folder)
    test = materialise(plan_shuffle_split(df, "o_orderkey", _FOLDS).test_rows(df))
    encoded, totals = _fold_encoding(df, test)
    scored = (
        test.withColumn("category", F.col("o_custkey").cast("string"))
        .join(encoded, ["fold", "category"], "left")
        .join(F.broadcast(totals), "fold")
        .withColumn("prediction", F.coalesce("enc", "prior"))
    )
    return rounded(metrics.r2_score(scored, "o_totalprice", "prediction", ["fold"]), "score")


@query(
    "metric_avg_precision",
    f"""
WITH {RETURNS_SQL},
points AS (SELECT l_linestatus, l_extendedprice AS s, count(*) AS n, sum(y) AS pos
           FROM returns GROUP BY 1, 2),
running AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS hits FROM points
            WINDOW w AS (PARTITION BY l_linestatus ORDER BY s DESC))
SELECT l_linestatus, round(sum(pos * hits / seen) / sum(pos), 6) AS score
FROM running GROUP BY 1""",
)
def metric_avg_precision(spark: SparkSession, folder: str) -> DataFrame:
    df = returns(spark, folder)
    scores = metrics.average_precision(df, "y", "l_extendedprice", ["l_linestatus"])
    return rounded(scores, "score")


@query(
    "metric_accuracy",
    """
WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
best AS (SELECT o_custkey, o_orderstatus AS prediction FROM c
         QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) = 1)
SELECT o_orderpriority, round(avg((o_orderstatus = prediction)::INTEGER), 6) AS score
FROM orders JOIN best USING (o_custkey) GROUP BY 1""",
)
def metric_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Predict each order's status by the most frequent one of its customer."""
    df = _orders(spark, folder)
    counts = df.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("o_custkey").agg(
        F.min_by("o_orderstatus", F.struct(-F.col("n"), F.col("o_orderstatus"))).alias("prediction")
    )
    scored = df.join(best, "o_custkey")
    scores = metrics.accuracy_score(scored, "o_orderstatus", "prediction", ["o_orderpriority"])
    return rounded(scores, "score")


@query(
    "class_weights",
    """
WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 6)
       AS weight
FROM orders JOIN c USING (o_orderstatus)""",
)
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    weighted = add_class_weights(_orders(spark, folder), "o_orderstatus")
    return rounded(weighted.select("o_orderkey", "weight"), "weight")


_MARKED_VECTORS = f"""
marked AS (SELECT vec_id, label, embedding::DOUBLE[] AS v,
                  row_number() OVER (ORDER BY {digest_sql("vec_id", SPLIT_SEED, "0")})
                    <= ceil(count(*) OVER () / 3.0::DOUBLE - 1e-9) AS is_test FROM embeddings),
pairs AS (SELECT q.vec_id AS query, t.vec_id AS neighbour, t.label,
                 sqrt(list_sum(list_transform(list_zip(q.v, t.v), lambda p: pow(p[1] - p[2], 2))))
                   AS dist
          FROM marked q JOIN marked t ON q.is_test AND NOT t.is_test),
best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS place
         FROM pairs QUALIFY place <= 5)"""


@query(
    "knn_exact",
    f"WITH {_MARKED_VECTORS} "
    "SELECT query, neighbour, place, round(dist, 6) AS dist FROM best",
)
def knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    split = shuffle_split(table(spark, folder, "embeddings"), "vec_id", 1)
    found = neighbours.nearest(
        split.where("not is_test"), split.where("is_test"), "vec_id", "embedding", "label"
    )
    return rounded(found.select("query", "neighbour", F.col("place").cast("long"), "dist"), "dist")


@query(
    "knn_classify",
    f"""
WITH {_MARKED_VECTORS},
votes AS (SELECT query, label, count(*) AS n FROM best GROUP BY 1, 2)
SELECT query, label::DOUBLE AS prediction FROM votes
QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1""",
)
def knn_classify(spark: SparkSession, folder: str) -> DataFrame:
    split = shuffle_split(table(spark, folder, "embeddings"), "vec_id", 1)
    found = neighbours.nearest(
        split.where("not is_test"), split.where("is_test"), "vec_id", "embedding", "label"
    )
    return neighbours.vote(found, MULTICLASS)


@query(
    "knn_regress",
    f"""
WITH {_MARKED_VECTORS}
SELECT query, round(avg(label), 6) AS prediction FROM best GROUP BY 1""",
)
def knn_regress(spark: SparkSession, folder: str) -> DataFrame:
    split = shuffle_split(table(spark, folder, "embeddings"), "vec_id", 1)
    found = neighbours.nearest(
        split.where("not is_test"), split.where("is_test"), "vec_id", "embedding", "label"
    )
    return rounded(neighbours.vote(found, REGRESSION), "prediction")


def _grams_sql(text: str, size: int) -> str:
    last = f"greatest(length({text}) - {size - 1}, 1)"
    return (
        f"list_distinct(list_transform(range(1, {last} + 1), "
        f"lambda i: substring({text}, i, {size})))"
    )


_TURNS_SQL = f"""
WITH turns AS (SELECT a.conv_id, a.turn, {{grams_a}} AS a, {{grams_b}} AS b
               FROM conversations a JOIN conversations b
               ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round({{score}}, 6) AS sim FROM turns"""
_JACCARD_SQL = "len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE"
_SORENSEN_SQL = "2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b))"


def _turns_sql(size: int, score: str) -> str:
    return _TURNS_SQL.format(
        grams_a=_grams_sql("a.text", size), grams_b=_grams_sql("b.text", size), score=score
    )


def _turns(spark: SparkSession, folder: str, measure) -> DataFrame:
    """Each message next to the one that follows it."""
    turns = table(spark, folder, "conversations")
    following = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")
    )
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(measure(F.col("text"), F.col("next")), 6).alias("sim")
    )


@query("sim_3gram", _turns_sql(3, _JACCARD_SQL))
def sim_3gram(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder, S.gram_similarity)


@query("sim_jaccard", _turns_sql(1, _JACCARD_SQL))
def sim_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder, S.jaccard_similarity)


@query("sim_sorensen", _turns_sql(1, _SORENSEN_SQL))
def sim_sorensen(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder, S.sorensen_similarity)


@query(
    "sim_lev",
    """
SELECT c_custkey, round(1 - levenshtein(c_name, n_name)
                        / greatest(length(c_name), length(n_name))::DOUBLE, 6) AS sim
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def sim_lev(spark: SparkSession, folder: str) -> DataFrame:
    customers, nations = table(spark, folder, "customer"), table(spark, folder, "nation")
    joined = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    sim = S.levenshtein_similarity(F.col("c_name"), F.col("n_name"))
    return joined.select("c_custkey", F.round(sim, 6).alias("sim"))


_BINS = [i / 10 for i in range(11)]


def _ball_sql(source: str, column: str) -> str:
    return f"""
WITH values AS (SELECT {column} AS value, count(*) AS weight, {_grams_sql(column, 3)} AS g
                FROM {source} GROUP BY {column}),
pairs AS (SELECT a.value, a.weight,
                 len(list_intersect(a.g, b.g))
                   / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE AS sim
          FROM values a CROSS JOIN values b)"""


@query(
    "similarity_ball",
    f"""{_ball_sql("part", "p_name")},
bins AS (SELECT unnest([{", ".join(f"{b}::DOUBLE" for b in _BINS)}]) AS bin)
SELECT bin, sum(CASE WHEN sim >= bin - 1e-9 THEN weight ELSE 0 END)::BIGINT AS n_pairs,
       round(sum(CASE WHEN sim >= bin - 1e-9 THEN weight ELSE 0 END)
             / (SELECT sum(weight) FROM values)::DOUBLE, 6) AS per_row
FROM pairs CROSS JOIN bins GROUP BY 1""",
)
def similarity_ball(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ball_counts(table(spark, folder, "part"), "p_name", _BINS), "per_row")


@query(
    "ball_by_row",
    f"""{_ball_sql("pages", "url")},
radii AS (SELECT unnest([0.0::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE, 1.0::DOUBLE]) AS radius)
SELECT value, radius, sum(CASE WHEN 1 - sim <= radius + 1e-9 THEN 1 ELSE 0 END)::BIGINT AS n
FROM pairs CROSS JOIN radii GROUP BY 1, 2""",
)
def ball_by_row(spark: SparkSession, folder: str) -> DataFrame:
    return ball_by_value(table(spark, folder, "pages"), "url", [0.0, 0.2, 0.4, 1.0])


_EDIT_BINS = [0.0, 0.7, 0.8, 0.9, 1.0]
_EDIT_SQL = """
WITH values AS (SELECT url AS value, count(*) AS weight FROM pages WHERE url IS NOT NULL GROUP BY url),
pairs AS (SELECT a.value, a.weight,
                 1 - levenshtein(a.value, b.value) / greatest(length(a.value), length(b.value), 1)::DOUBLE AS sim
          FROM values a CROSS JOIN values b)"""


@query(
    "edit_ball",
    f"""{_EDIT_SQL},
bins AS (SELECT unnest([{", ".join(f"{b}::DOUBLE" for b in _EDIT_BINS)}]) AS bin)
SELECT bin, sum(CASE WHEN sim >= bin - 1e-9 THEN weight ELSE 0 END)::BIGINT AS n_pairs,
       round(sum(CASE WHEN sim >= bin - 1e-9 THEN weight ELSE 0 END)
             / (SELECT sum(weight) FROM values)::DOUBLE, 6) AS per_row
FROM pairs CROSS JOIN bins GROUP BY 1""",
)
def edit_ball(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses within an edit similarity of each other."""
    return rounded(ball_counts(table(spark, folder, "pages"), "url", _EDIT_BINS, "levenshtein"), "per_row")


@query(
    "edit_ball_by_row",
    f"""{_EDIT_SQL},
radii AS (SELECT unnest([0.0::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 1.0::DOUBLE]) AS radius)
SELECT value, radius, sum(CASE WHEN 1 - sim <= radius + 1e-9 THEN 1 ELSE 0 END)::BIGINT AS n
FROM pairs CROSS JOIN radii GROUP BY 1, 2""",
)
def edit_ball_by_row(spark: SparkSession, folder: str) -> DataFrame:
    """How many addresses each address has within an edit distance relative to the longer one."""
    return ball_by_value(table(spark, folder, "pages"), "url", [0.0, 0.2, 0.3, 1.0], "levenshtein")


@query(
    "zipf_pmf",
    """
WITH counts AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
ranked AS (SELECT n, row_number() OVER (ORDER BY n DESC, user_id) AS category,
                  count(*) OVER () AS k FROM counts),
total AS (SELECT sum(pow(category::DOUBLE, -0.5)) AS w, sum(n) AS n_rows FROM ranked)
SELECT category, n AS observed, round(pow(category::DOUBLE, -0.5) / w, 9) AS p,
       round(pow(category::DOUBLE, -0.5) / w * n_rows, 6) AS expected
FROM ranked CROSS JOIN total""",
)
def zipf_pmf(spark: SparkSession, folder: str) -> DataFrame:
    """Observed counts by rank beside a bounded Zipf law over as many categories."""
    events = table(spark, folder, "events")
    curve = profile.rank_frequency(events, ["user_id"])
    k = profile.distinct_values(events, ["user_id"]).count()
    law = synth.zipf_pmf(spark, k, 0.5)
    return curve.join(law, F.col("rank") == F.col("category")).select(
        "category",
        F.col("n").alias("observed"),
        F.round("p", 9).alias("p"),
        F.round(F.col("p") * events.select(F.count(F.lit(1))).scalar(), 6).alias("expected"),
    )


_CLASSES = ["F", "O", "P"]
_N_DRAWN = 40
_DRAW = uniform_sql(digest_sql("o_orderkey", MODEL_SEED, "'drawn'"))


@query(
    "synth_category",
    f"""
WITH classes AS (SELECT unnest(['F', 'O', 'P']) AS class, unnest([0, 1, 2]) AS place),
grid AS (SELECT category, class, 1 + (category + place) % 3 AS raw,
                pow(category::DOUBLE, -1.0) AS w
         FROM (SELECT unnest(range(1, {_N_DRAWN + 1})) AS category) CROSS JOIN classes),
slots AS (SELECT category, class,
                 round_even(raw / sum(raw) OVER (PARTITION BY category)::DOUBLE
                            * (w / (sum(w) OVER () / 3)) * (SELECT count(*) FROM orders), 0)::BIGINT
                   AS slots
          FROM grid),
ranges AS (SELECT category, class, slots, sum(slots) OVER (PARTITION BY class ORDER BY category) AS hi,
                  sum(slots) OVER (PARTITION BY class) AS total FROM slots WHERE slots > 0),
totals AS (SELECT DISTINCT class, total FROM ranges),
drawn AS (SELECT o_orderkey, o_orderstatus, floor({_DRAW} * total) AS slot
          FROM orders JOIN totals ON o_orderstatus = class)
SELECT o_orderkey, o_orderstatus, category::INTEGER AS drawn
FROM drawn JOIN ranges ON o_orderstatus = class AND slot >= hi - slots AND slot < hi""",
)
def synth_category(spark: SparkSession, folder: str) -> DataFrame:
    """Category numbers for the orders, drawn given their status with fixed class shares."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    place = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(i).alias("place"))
                      for i, c in enumerate(_CLASSES)])
    raw = spark.range(1, _N_DRAWN + 1).select(
        F.col("id").alias("category"), F.inline(place)
    ).withColumn("raw", 1 + (F.col("category") + F.col("place")) % 3)
    sums = raw.groupBy("category").agg(F.sum("raw").alias("all"))
    weights = raw.join(sums, "category").select(
        "category", "class", (F.col("raw") / F.col("all")).alias("weight")
    )
    return synth.category_given_target(
        orders, "o_orderkey", "o_orderstatus", _N_DRAWN, 1.0, weights, "drawn"
    )


@query("synth_categories_multi")
def synth_categories_multi(spark: SparkSession, folder: str) -> DataFrame:
    """The preset of three columns, drawn for the returned items."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return synth.categories_given_target(
        orders, "o_orderkey", "o_orderstatus", _CLASSES, **synth.RANDOM_PRESET
    )


