"""Feature preparation, outliers, clusters and projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugework.operators import clustering, dbscan, features, kmeans, outliers, profile, projection
from gaugework.operators.profile import PROFILE_FIELDS
from gaugework.queries import inputs as I
from gaugework.queries.oracle import profile_ctes, r
from gaugework.queries.registry import query, rounded
from gaugework.session import shared_folder
from gaugework.sources import sinks
from gaugework.sources.metrics import read_table

PROFILE_FEATURES = list(PROFILE_FIELDS[1:])

# The weights of the shipped example, its misspelt key included.
WEIGHTS = {
    "metric_name": 0.0, "min": 0.0, "max": 2.0, "mean": 0.0, "median": 0.0, "std_dev": 3.0, "skewness": 0.0,
    "kurtosis": 0.0, "p05": 1.0, "p25": 7.0, "p75": 7.0, "p95": 4.0, "iqr": 0.0, "null_count": 1.0,
    "nul_percentage": 0.0, "non_zero_records": 0.0, "zero_count": 2.0, "zero_percentage": 0.0, "total_records": 0.0,
}


def user_profiles(spark, folder):
    """The profile table of the user metrics; small, used several times."""
    return profile.profile(I.user_metrics(spark, folder)).persist()


# -- SQL of the prepared features ---------------------------------------------------


def _q(name: str) -> str:
    return f'"{name}"'


def _filled(source: str, names: list[str]) -> str:
    medians = ", ".join(f"quantile_cont({_q(n)}::DOUBLE, 0.5) AS {_q(n)}" for n in names)
    cells = ", ".join(f"coalesce(p.{_q(n)}::DOUBLE, m.{_q(n)}, 0) AS {_q(n)}" for n in names)
    return (
        f"med AS (SELECT {medians} FROM {source}), "
        f"filled AS (SELECT metric_name, {cells} FROM {source} p, med m)"
    )


def _scaled(names: list[str], center: str, spread: str, weights: list[float]) -> str:
    stats = ", ".join(
        f"{center.format(_q(n))} AS {_q('c_' + n)}, {spread.format(_q(n))} AS {_q('s_' + n)}" for n in names
    )
    cells = ", ".join(
        f"(f.{_q(n)} - {_q('c_' + n)}) / coalesce(nullif({_q('s_' + n)}, 0.0), 1.0) * {w}::DOUBLE AS {_q(n)}"
        for n, w in zip(names, weights)
    )
    return f"stats AS (SELECT {stats} FROM filled), prepared AS (SELECT metric_name, {cells} FROM filled f, stats)"


STANDARD = ("avg({0})", "CASE WHEN min({0}) = max({0}) THEN 0 ELSE stddev_pop({0}) END")
ROBUST = ("quantile_cont({0}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)")
MINMAX = ("min({0})", "max({0}) - min({0})")


def _prepared_sql(form, weights=None, names=PROFILE_FEATURES, source=I.USER_LONG) -> str:
    return (
        f"WITH {source}, {profile_ctes()}, {_filled('profile', names)}, "
        + _scaled(names, *form, weights or [1.0] * len(names))
    )


def _select(names=PROFILE_FEATURES, source="prepared") -> str:
    return f"SELECT metric_name, {', '.join(f'{r(_q(n))} AS {_q(n)}' for n in names)} FROM {source}"


# -- preparation ---------------------------------------------------------------------


@query(
    "impute_median",
    f"WITH {I.USER_LONG}, {profile_ctes()}, {_filled('profile', PROFILE_FEATURES)} {_select(source='filled')}",
)
def impute_median(spark, folder):
    return rounded(features.impute_median(user_profiles(spark, folder), "metric_name", PROFILE_FEATURES))


@query(
    "impute_median_gaps",
    f"WITH {I.HOURLY} SELECT ts, "
    + ", ".join(f"{r(f'coalesce({e}, (SELECT quantile_cont({e}, 0.5) FROM hourly))')} AS {e}" for e in I.EVENT_TYPES)
    + " FROM hourly",
)
def impute_median_gaps(spark, folder):
    return rounded(features.impute_median(I.hourly_events(spark, folder), "ts", I.EVENT_TYPES))


def _prepare(name, form, method, weights=None, weight_list=None):
    @query(name, _prepared_sql(form, weight_list) + " " + _select())
    def run(spark, folder):
        profiles = user_profiles(spark, folder)
        return rounded(features.fit_preparation(profiles, method=method, weights=weights).only(profiles))


BY_NAME = [WEIGHTS.get(n, 1.0) for n in PROFILE_FEATURES]
BY_POSITION = [0.5 * (i % 4) for i in range(len(PROFILE_FEATURES))]

_prepare("scale_standard", STANDARD, "standard")
_prepare("scale_robust", ROBUST, "robust")
_prepare("scale_minmax", MINMAX, "minmax")
_prepare("weights_dict", STANDARD, "standard", WEIGHTS, BY_NAME)
_prepare("weights_list", STANDARD, "standard", BY_POSITION, BY_POSITION)


@query(
    "describe_prepared",
    _prepared_sql(STANDARD, BY_NAME)
    + ", long2 AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS feature, {_q(n)} AS v FROM prepared" for n in PROFILE_FEATURES)
    + f""") SELECT feature, count(v) AS n, {r("avg(v)")} AS mean,
      {r("CASE WHEN min(v) = max(v) THEN 0 ELSE stddev_samp(v) END")} AS std,
      {r("min(v)")} AS "min", {r("quantile_cont(v, 0.25)")} AS p25, {r("quantile_cont(v, 0.5)")} AS p50,
      {r("quantile_cont(v, 0.75)")} AS p75, {r("max(v)")} AS "max" FROM long2 GROUP BY feature""",
)
def describe_prepared(spark, folder):
    profiles = user_profiles(spark, folder)
    prep = features.fit_preparation(profiles, weights=WEIGHTS)
    return rounded(profile.describe(prep.only(profiles), prep.features))


# -- outliers ----------------------------------------------------------------------------

ZSCORE = (
    "z AS (SELECT metric_name, "
    + " OR ".join(
        f"coalesce(abs(({_q(n)} - avg({_q(n)}) OVER ()) / CASE WHEN min({_q(n)}) OVER () < max({_q(n)}) OVER () "
        f"THEN stddev_pop({_q(n)}) OVER () END) > 3, false)"
        for n in PROFILE_FEATURES
    )
    + " AS is_outlier FROM prepared)"
)


def _flagged(spark, folder, method, **settings):
    run = clustering.Clustering(outlier_method=method, **settings)
    return run.flag(user_profiles(spark, folder))


@query("outlier_zscore", _prepared_sql(STANDARD) + f", {ZSCORE} SELECT metric_name, is_outlier FROM z")
def outlier_zscore(spark, folder):
    return _flagged(spark, folder, "zscore")[0].select("metric_name", "is_outlier")


@query(
    "outlier_split",
    _prepared_sql(STANDARD)
    + f""", {ZSCORE} SELECT 'main' AS part, count(*) AS n_rows FROM z WHERE NOT is_outlier
    UNION ALL SELECT 'outlier', count(*) FROM z WHERE is_outlier""",
)
def outlier_split(spark, folder):
    flagged, _ = _flagged(spark, folder, "zscore")
    main, outlying = outliers.split_outliers(flagged)
    count = F.count("*").alias("n_rows")
    return main.agg(count).select(F.lit("main").alias("part"), "n_rows").unionByName(
        outlying.agg(count).select(F.lit("outlier").alias("part"), "n_rows")
    )


@query(
    "outlier_points",
    _prepared_sql(STANDARD, BY_NAME)
    + f""", {ZSCORE} SELECT metric_name, {r("p.mean")} AS prepared_mean, {r("p.median")} AS prepared_median, is_outlier
    FROM prepared p JOIN z USING (metric_name)""",
)
def outlier_points(spark, folder):
    flagged, prep = _flagged(spark, folder, "zscore", weights=WEIGHTS)
    return rounded(clustering.outlier_points(flagged, prep.key, prep.prepared))


@query("outlier_iforest")
def outlier_iforest(spark, folder):
    return _flagged(spark, folder, "isolation_forest", outlier_fraction=0.07)[0].select("metric_name", "is_outlier")


PLANTED = [f"f{i}" for i in range(8)]


@query("outlier_iforest_planted", "SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0")
def outlier_iforest_planted(spark, folder):
    """Every hundredth vector is moved far away; the forest flags these and no others."""
    far = F.col("vec_id") % 100 == 0
    moved = [F.when(far, F.col(f) * 50 + 40).otherwise(F.col(f)).alias(f) for f in PLANTED]
    points = I.vectors(spark, folder).select("vec_id", *moved)
    return outliers.isolation_forest_flags(points, "vec_id", PLANTED, 0.01).where("is_outlier").select("vec_id")


# -- density clusters ----------------------------------------------------------------------

DENSITY_FEATURES = ["mean", "std_dev", "zero_percentage"]
EPS, MIN_POINTS = 0.5, 5

DENSITY = (
    _prepared_sql(STANDARD, names=DENSITY_FEATURES, source=I.SUPPLIER_LONG)
    + ", near AS (SELECT a.metric_name AS a, b.metric_name AS b FROM prepared a, prepared b WHERE "
    + " + ".join(f"pow(a.{n} - b.{n}, 2)" for n in DENSITY_FEATURES)
    + f" <= {EPS * EPS}), core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= {MIN_POINTS}), "
    "links AS (SELECT n.a, n.b FROM near n SEMI JOIN core c ON n.a = c.a WHERE n.b IN (SELECT a FROM core)), "
    "reach AS (SELECT a, a AS b FROM core UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a), "
    "comp AS (SELECT a, min(b) AS least FROM reach GROUP BY a), "
    "numbered AS (SELECT least, (row_number() OVER (ORDER BY least) - 1)::INT AS cluster FROM (SELECT DISTINCT least FROM comp)), "
    "labelled AS (SELECT metric_name, coalesce(min(CASE WHEN own.a IS NULL OR n.b = p.metric_name THEN cluster END), -1)::INT "
    "AS cluster FROM prepared p LEFT JOIN core own ON own.a = p.metric_name "
    "LEFT JOIN near n ON p.metric_name = n.a AND n.b IN (SELECT a FROM core) "
    "LEFT JOIN comp ON n.b = comp.a LEFT JOIN numbered USING (least) GROUP BY metric_name)"
).replace("WITH ", "WITH RECURSIVE ", 1)


def _density_input(spark, folder):
    profiles = profile.profile(I.supplier_metrics(spark, folder)).persist()
    prep = features.fit_preparation(profiles, features=DENSITY_FEATURES)
    return prep.beside(profiles), prep


@query("dbscan", DENSITY + " SELECT metric_name, cluster FROM labelled")
def dbscan_clusters(spark, folder):
    prepared, prep = _density_input(spark, folder)
    return dbscan.cluster(prepared, prep.key, prep.prepared).select("metric_name", "cluster")


@query("clustered_csv", DENSITY + " SELECT metric_name, cluster::BIGINT AS cluster FROM labelled")
def clustered_csv(spark, folder):
    """The clustered table written as CSV and read again with its types."""
    path = f"{shared_folder(spark)}/clustered-{uuid.uuid4().hex}"
    return read_table(spark, sinks.write_csv(dbscan_clusters(spark, folder), path))


@query("outlier_dbscan", DENSITY + " SELECT metric_name, cluster < 0 AS is_outlier FROM labelled")
def outlier_dbscan(spark, folder):
    prepared, prep = _density_input(spark, folder)
    return dbscan.noise_flags(prepared, prep.key, prep.prepared).select("metric_name", "is_outlier")


# -- k-means --------------------------------------------------------------------------------


def _vectors(spark, folder):
    return I.vectors(spark, folder).drop("cluster").persist()


@query("kmeans")
def kmeans_clusters(spark, folder):
    points = _vectors(spark, folder)
    model = kmeans.fit(points, "vec_id", I.FEATURES, 3)
    return kmeans.by_least_key(kmeans.assign(points, I.FEATURES, model), "vec_id", model).select("vec_id", "cluster")


def _given_centers(points, k):
    """The first vectors as centres, so that another engine can use the same."""
    rows = points.where(F.col("vec_id") < k).orderBy("vec_id").select(*I.FEATURES).collect()  # k rows
    return [list(r) for r in rows]


# Squared distances of all vectors to the first ones, which serve as centres 0, 1, ..
TO_CENTERS = """points AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    far AS (SELECT p.vec_id, p.e, c.vec_id AS cluster, pow(list_distance(p.e, c.e), 2) AS d FROM points p, points c WHERE c.vec_id < 5)"""


@query(
    "kmeans_assignment",
    f"WITH {TO_CENTERS} SELECT vec_id, arg_min(cluster, (d, cluster))::INT AS cluster FROM far GROUP BY vec_id",
)
def kmeans_assignment(spark, folder):
    """Every vector's nearest of five given centres."""
    points = _vectors(spark, folder)
    model = kmeans.from_centers(points, I.FEATURES, _given_centers(points, 5))
    return kmeans.assign(points, I.FEATURES, model).select("vec_id", "cluster")


@query(
    "kmeans_step",
    f"""WITH {TO_CENTERS}, own AS (SELECT vec_id, any_value(e) AS e, arg_min(cluster, (d, cluster))::INT AS cluster, min(d) AS d FROM far GROUP BY vec_id)
    SELECT cluster, count(*)::DOUBLE AS size, {", ".join(f"{r(f'avg(e[{i + 1}])')} AS f{i}" for i in range(4))}, {r("sum(sum(d)) OVER ()")} AS wcss
    FROM own GROUP BY cluster""",
)
def kmeans_step(spark, folder):
    """The centres that one pass moves to, the rows of each and the cost of the pass."""
    points = _vectors(spark, folder)
    model = kmeans.from_centers(points, I.FEATURES, _given_centers(points, 5))
    rows = [(i, float(model.sizes[i]), *map(float, model.means[i][:4]), float(model.cost)) for i in range(model.k) if model.sizes[i]]
    return rounded(spark.createDataFrame(rows, "cluster int, size double, f0 double, f1 double, f2 double, f3 double, wcss double"))


@query(
    "k_choice",
    f"""WITH {TO_CENTERS}, ks AS (SELECT unnest([2, 3, 4, 5])::INT AS k),
    own AS (SELECT k, vec_id, any_value(e) AS e, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM far JOIN ks ON cluster < k GROUP BY k, vec_id),
    sizes AS (SELECT k, cluster, count(*) AS n FROM own GROUP BY ALL),
    met AS (SELECT a.k, a.vec_id, a.cluster AS own, b.cluster AS other, sum(pow(list_distance(a.e, b.e), 2)) AS d FROM own a JOIN own b USING (k) GROUP BY ALL),
    means AS (SELECT m.k, vec_id, max(CASE WHEN own = other THEN s.n END) AS n, max(CASE WHEN own = other THEN d / greatest(s.n - 1, 1) END) AS a,
        min(CASE WHEN own <> other THEN d / s.n END) AS b FROM met m JOIN sizes s ON s.k = m.k AND s.cluster = m.other GROUP BY ALL),
    scores AS (SELECT k, avg(CASE WHEN n = 1 OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS s FROM means GROUP BY k),
    costs AS (SELECT k, sum(d) AS c FROM own GROUP BY k)
    SELECT k, {r("c")} AS wcss, {r("s")} AS silhouette, k = first_value(k) OVER (ORDER BY s DESC, k) AS best FROM scores JOIN costs USING (k)""",
)
def k_choice(spark, folder):
    """Cost and silhouette of given models with two to five centres, and the choice among them."""
    points = _vectors(spark, folder)
    models = [kmeans.from_centers(points, I.FEATURES, _given_centers(points, k)) for k in (2, 3, 4, 5)]
    return rounded(kmeans.k_table(points, I.FEATURES, models))


@query("select_k")
def select_k(spark, folder):
    profiles = user_profiles(spark, folder)
    prep = features.fit_preparation(profiles, weights=WEIGHTS)
    return kmeans.select_k(prep.beside(profiles), prep.key, prep.prepared)


@query(
    "elbow",
    """WITH curve AS (SELECT l_returnflag, l_linenumber + 1 AS k,
      sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag) * 20 AS wcss
      FROM lineitem GROUP BY l_returnflag, l_linenumber),
    steps AS (SELECT l_returnflag, k, lag(wcss) OVER w - wcss AS up, lead(wcss) OVER w - wcss AS down FROM curve
      WINDOW w AS (PARTITION BY l_returnflag ORDER BY k)),
    angles AS (SELECT l_returnflag, k, acos(greatest(-1.0, least(1.0, (1 + up * down) / (sqrt(1 + up * up) * sqrt(1 + down * down))))) AS angle
      FROM steps WHERE up IS NOT NULL AND down IS NOT NULL)
    SELECT l_returnflag, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY angle DESC, k) AS rank FROM angles)
    WHERE rank = 1""",
)
def elbow(spark, folder):
    """The elbow of a curve per return flag: the quantity share of each line number."""
    lines = I.table(spark, folder, "lineitem")
    sums = lines.groupBy("l_returnflag", (F.col("l_linenumber") + 1).alias("k")).agg(F.sum("l_quantity").alias("part"))
    whole = lines.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("whole"))
    curve = sums.join(whole, "l_returnflag").withColumn("wcss", F.col("part") / F.col("whole") * 20)
    return kmeans.elbow(curve.select("l_returnflag", "k", "wcss"), by=["l_returnflag"])


@query("fit_predict")
def fit_predict(spark, folder):
    run = clustering.Clustering(outlier_fraction=0.07, weights=WEIGHTS, n_clusters=3)
    return run.fit_predict(user_profiles(spark, folder), auto_optimize=True).select("metric_name", "cluster")


# -- cluster tables: the given labels of the embeddings serve as clusters ---------------------


@query(
    "cluster_sizes",
    f"""SELECT label AS cluster, count(*) AS n_rows, {r("count(*)::DOUBLE / (SELECT count(*) FROM embeddings) * 100")} AS percentage
    FROM embeddings GROUP BY label""",
)
def cluster_sizes(spark, folder):
    return rounded(clustering.cluster_sizes(I.vectors(spark, folder)))


@query(
    "cluster_means",
    f"WITH {I.VECTORS} SELECT cluster, {', '.join(f'{r(f'avg({f})')} AS {f}' for f in I.FEATURES[:3])} FROM vectors GROUP BY cluster",
)
def cluster_means(spark, folder):
    return rounded(clustering.cluster_means(I.vectors(spark, folder), I.FEATURES[:3]))


@query("distinct_labels", "SELECT count(DISTINCT label) AS n_labels FROM embeddings")
def distinct_labels(spark, folder):
    return clustering.distinct_labels(I.vectors(spark, folder))


# -- projection ---------------------------------------------------------------------------------


@query("pca_points")
def pca_points(spark, folder):
    return projection.pca_points(I.vectors(spark, folder), I.FEATURES, ["vec_id", "cluster"])


@query("explained_variance")
def explained_variance(spark, folder):
    return projection.explained_variance(I.vectors(spark, folder), I.FEATURES)


@query("feature_importance")
def feature_importance(spark, folder):
    profiles = user_profiles(spark, folder)
    prep = features.fit_preparation(profiles, weights=WEIGHTS)
    return projection.feature_importance(prep.beside(profiles), prep.prepared, prep.features)


# -- projection of the prepared profiles, whose first components stand apart, beside power iteration ------


def _power(name: str, matrix: str) -> str:
    """CTE ``name`` (v): the leading eigenvector of the list of lists ``c`` in the CTE ``matrix``."""
    start = ", ".join(f"{1 / (i + 1)}::DOUBLE" for i in range(len(PROFILE_FEATURES)))
    return f"""{name}_steps AS (SELECT 0 AS step, [{start}] AS v
        UNION ALL SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
        FROM (SELECT step, list_transform(c, lambda line: list_dot_product(line, v)) AS w FROM {name}_steps, {matrix} WHERE step < 500)),
    {name} AS (SELECT v, list_dot_product(v, list_transform(c, lambda line: list_dot_product(line, v))) AS value FROM {name}_steps, {matrix} WHERE step = 500)"""


_LINES = ", ".join("[" + ", ".join(f"covar_samp({_q(a)}, {_q(b)})" for b in PROFILE_FEATURES) + "]" for a in PROFILE_FEATURES)
COMPONENTS = (
    _prepared_sql(STANDARD, BY_NAME).replace("WITH ", "WITH RECURSIVE ", 1)
    + f", gram AS (SELECT [{_LINES}] AS c FROM prepared), {_power('one', 'gram')}, "
    + "rest AS (SELECT list_transform(c, lambda line, i: list_transform(line, lambda x, j: x - value * v[i] * v[j])) AS c FROM gram, one), "
    + _power("two", "rest")
)
_TRACE = " + ".join(f"c[{i + 1}][{i + 1}]" for i in range(len(PROFILE_FEATURES)))


def _prepared_profiles(spark, folder):
    profiles = user_profiles(spark, folder)
    prep = features.fit_preparation(profiles, weights=WEIGHTS)
    return prep.beside(profiles), prep


@query(
    "profile_importance",
    COMPONENTS + f" SELECT unnest({PROFILE_FEATURES!r}) AS feature, unnest(list_transform(v, lambda x: {r('abs(x)')})) AS importance FROM one",
)
def profile_importance(spark, folder):
    prepared, prep = _prepared_profiles(spark, folder)
    return rounded(projection.feature_importance(prepared, prep.prepared, prep.features))


@query(
    "profile_variance",
    COMPONENTS
    + f""" SELECT 1 AS component, {r(f"value / ({_TRACE})")} AS explained_variance FROM one, gram
    UNION ALL SELECT 2, {r(f"two.value / ({_TRACE})")} FROM two, gram""",
)
def profile_variance(spark, folder):
    prepared, prep = _prepared_profiles(spark, folder)
    return rounded(projection.explained_variance(prepared, prep.prepared))


_SIGNED = "CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END"
_CENTRED = ", ".join(f"{_q(n)} - avg({_q(n)}) OVER ()" for n in PROFILE_FEATURES)


@query(
    "profile_components",
    COMPONENTS
    + f""", placed AS (SELECT metric_name, [{_CENTRED}] AS x FROM prepared)
    SELECT metric_name, {r(f"list_dot_product(x, v) * {_SIGNED}", 4)} AS pc1 FROM placed, one""",
)
def profile_components(spark, folder):
    prepared, prep = _prepared_profiles(spark, folder)
    return rounded(projection.pca_points(prepared, prep.prepared, [prep.key], k=1), 4)
