"""Registered queries: every operator on the given tables, whole tables only.

``events`` plays the flow log (``event_id`` is the key, ``event_type`` the class, ``view`` the
benign one). ``lineitem`` is a flow log in which (``l_orderkey``, ``l_linenumber``) repeats.
Samples and splits use the md5 key here, because other SQL engines can compute it.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from uuid import uuid4

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmark.functions.durable import compact, durable, ensure_checkpoint_dir, local_table, side_table
from flowmark.functions.scalars import text_value
from flowmark.operators import auroc_state as A
from flowmark.operators import compare as C
from flowmark.operators import metrics as M
from flowmark.operators import profile as P
from flowmark.operators import reduction as R
from flowmark.operators import sampling as X
from flowmark.operators import svm as V
from flowmark.operators.features import feature_frame, fit_features, policy
from flowmark.operators.growing import GrowingCap, GrowingQuota
from flowmark.operators.tasks import (
    DatasetSpec,
    Protocol,
    build_task_frame,
    build_task_frames,
    task_labels,
)
from flowmark.plans.audit import METRIC_SCHEMA, TIMING_SCHEMA, audit_run
from flowmark.plans.experiment import run
from flowmark.sources import scan as S
from flowmark.sources.artifacts import publish_run, read_table
from flowmark.sources.ledger import CensusLedger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EVENTS = DatasetSpec("events", ("click", "error", "purchase", "signup"))
LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_TIES = ["l_partkey", "l_suppkey"]


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tactic = F.when(F.col("event_type") == "view", "none").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").withColumn("label_tactic", tactic).drop("event_type")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles of an aggregate, rounded: engines add them up in different orders."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.select(
        *[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns]
    )


# --- sources -------------------------------------------------------------------------------


@register
def class_census(spark, sf_dir):
    return S.class_census(table(spark, sf_dir, "events"), "event_type")


@register
def file_census(spark, sf_dir):
    files = S.file_census(spark, sf_dir)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "rows")


@register
def schema_census(spark, sf_dir):
    return S.schema_census(spark, sf_dir)


CENSUS_LABELS = {
    "conversations": "role",
    "documents": "lang",
    "events": "event_type",
    "lineitem": "l_returnflag",
    "orders": "o_orderstatus",
}


def _stacked_census(spark, sf_dir, labels):
    counted = [
        table(spark, sf_dir, name)
        .groupBy(F.col(label).alias("label_tactic"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("dataset"), "*")
        for name, label in labels.items()
    ]
    return X.union_all(counted)


@register
def multi_dataset_census(spark, sf_dir):
    return _stacked_census(spark, sf_dir, CENSUS_LABELS)


EXPECTED = [
    DatasetSpec("events", (), files=1, rows=10_000, class_rows={"view": 2_000, "click": 2_000}),
    DatasetSpec(
        "orders", (), files=2, rows=15_000, class_rows={"F": 4_933, "O": 4_979, "P": 5_088}
    ),
]


@register
def inventory_validation(spark, sf_dir):
    labels = {name: CENSUS_LABELS[name] for name in ("events", "orders")}
    found = X.union_all(
        [
            S.totals(
                spark,
                name,
                S.file_census(spark, f"{sf_dir}/{name}.parquet"),
                S.schema_census(spark, f"{sf_dir}/{name}.parquet"),
            )
            for name in labels
        ]
    )
    return S.validate(
        found,
        _stacked_census(spark, sf_dir, labels),
        S.expected_totals(spark, EXPECTED),
        S.expected_classes(spark, EXPECTED),
    )


@register
def inventory(spark, sf_dir):
    """The inventory of two datasets from their files: totals, classes and problems in one table."""
    roots = {spec.name: f"{sf_dir}/{spec.name}.parquet" for spec in EXPECTED}
    found = S.inventory(spark, roots, EXPECTED, CENSUS_LABELS)
    sizes = [F.struct(F.lit(x).alias("item"), F.col(x).cast("bigint").alias("n")) for x in ("files", "rows", "schemas")]
    totals = found["totals"].select("dataset", F.explode(F.array(*sizes)).alias("x")).select("dataset", "x.item", "x.n")
    classes = found["classes"].select("dataset", F.concat(F.lit("class "), "label_tactic").alias("item"), "n")
    problems = found["problems"].select("dataset", F.col("message").alias("item"), F.lit(None).cast("bigint").alias("n"))
    return totals.unionByName(classes).unionByName(problems)


def _shared_folder(spark, name):
    """A new folder on the storage that holds checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


@register
def census_ledger(spark, sf_dir):
    """Class counts by way of a ledger, and how many files a second census opened again."""
    parts = []
    for name, label in CENSUS_LABELS.items():
        ledger = CensusLedger(spark, _shared_folder(spark, "ledger"), label)
        path = f"{sf_dir}/{name}.parquet"
        ledger.update(path)
        again = ledger.update(path)
        counted = ledger.classes(path).select(F.lit(name).alias("dataset"), "label_tactic", "n")
        parts.append(counted.withColumn("opened_again", F.lit(again)))
    return X.union_all(parts)


# --- tasks, samples, splits ----------------------------------------------------------------


@register
def task_frame_binary(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    return build_task_frame(flows, EVENTS.label_mapping("click")).select(
        "event_id", "label_tactic", "label"
    )


@register
def task_frames(spark, sf_dir):
    return build_task_frames(event_flows(spark, sf_dir), [EVENTS]).select(
        "event_id", "task", "kind", "label_tactic", "label"
    )


@register
def class_cap(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return X.class_cap(events, ["event_type"], ["event_id"], 500, kind="md5")


def _line_flows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE_TIES, "l_returnflag")


@register
def class_cap_cutoff(spark, sf_dir):
    return X.class_cap(
        _line_flows(spark, sf_dir), ["l_returnflag"], LINE_KEY, 7_000,
        kind="md5", tie_cols=LINE_TIES, strategy="cutoff",
    )


@register
def class_cap_hot_key(spark, sf_dir):
    """Three keys for the whole table: the cut falls between rows of one key."""
    return X.class_cap(
        _line_flows(spark, sf_dir), ["l_returnflag"], ["l_returnflag"], 9_000,
        kind="md5", tie_cols=[*LINE_KEY, *LINE_TIES], strategy="cutoff",
    )


@register
def class_cap_null_key(spark, sf_dir):
    """Two of five keys are null, and with them one class may be filled."""
    key = F.when(F.col("event_id") % 5 >= 2, F.col("event_id")).alias("key")
    events = table(spark, sf_dir, "events").select(key, "event_id", "event_type")
    window, cutoff = (
        X.class_cap(
            events, ["event_type"], ["key"], 700, kind="md5", tie_cols=["event_id"], strategy=s
        ).withColumn("strategy", F.lit(s))
        for s in ("window", "cutoff")
    )
    return window.unionByName(cutoff)


def _line_halves(spark, sf_dir):
    lines = _line_flows(spark, sf_dir)
    return [lines.filter(F.col("l_orderkey") % 2 == i) for i in (0, 1)]


@register
def growing_cap(spark, sf_dir):
    """The capped sample of a table that came in two halves."""
    state = GrowingCap(
        spark, _shared_folder(spark, "cap"), ["l_returnflag"], LINE_KEY, 7_000, kind="md5", tie_cols=LINE_TIES
    )
    for half in _line_halves(spark, sf_dir):
        sample = state.add(half)
    return sample


@register
def growing_quota(spark, sf_dir):
    """The quota sample of a table that came in two halves."""
    state = GrowingQuota(
        spark, _shared_folder(spark, "quota"), "l_returnflag", LINE_KEY, 0.85,
        protected=["A"], kind="md5", tie_cols=LINE_TIES,
    )
    halves = _line_halves(spark, sf_dir)
    for half in halves:
        state.add(half)
    return state.sample(halves[0], _line_flows(spark, sf_dir))


def _task_counts(spark, sf_dir):
    frames = build_task_frames(event_flows(spark, sf_dir), [EVENTS])
    return X.class_counts(frames, ["task", "label_tactic"])


@register
def quota_allocation(spark, sf_dir):
    return X.quotas(_task_counts(spark, sf_dir), 0.9, by=["task"], protected=["purchase"])


@register
def quota_sample(spark, sf_dir):
    lines = _line_flows(spark, sf_dir)
    counts = X.class_counts(lines, ["l_returnflag"])
    wanted = X.quotas(counts, 0.85, label="l_returnflag", protected=["A"])
    return X.quota_sample(
        lines, wanted, ["l_returnflag"], LINE_KEY, kind="md5", tie_cols=LINE_TIES
    )


@register
def sample_metadata(spark, sf_dir):
    wanted = X.quotas(_task_counts(spark, sf_dir), 0.9, by=["task"], protected=["purchase"])
    return X.sample_metadata(wanted, 0.9, by=["task"], protected=["purchase"]).select(
        "task", "policy", "reported_reduction", "source_rows", "target_rows",
        "protected_retained", F.to_json("target_class_counts").alias("target_class_counts"),
    )


@register
def hash_split(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY)
    return X.hash_split(lines, LINE_KEY, kind="md5")


@register
def stratified_split(spark, sf_dir):
    """The exact share of every class on the train side."""
    return X.hash_split(
        _line_flows(spark, sf_dir), LINE_KEY, kind="md5", per_class=["l_returnflag"], tie_cols=LINE_TIES
    )


@register
def stratified_split_hot_key(spark, sf_dir):
    """One key for each class: the edge falls between rows of one key."""
    return X.stratified_split(
        _line_flows(spark, sf_dir), ["l_returnflag"], ["l_returnflag"],
        kind="md5", tie_cols=[*LINE_KEY, *LINE_TIES],
    )


@register
def content_split(spark, sf_dir):
    """Rows of few columns, each of which comes many times, dealt to the sides one by one."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    return X.content_split(lines.withColumn("l_quantity", F.col("l_quantity").cast("int")), kind="md5")


@register
def class_counts_by_split(spark, sf_dir):
    flows = X.hash_split(event_flows(spark, sf_dir), ["event_id"], kind="md5")
    return X.class_counts(build_task_frames(flows, [EVENTS]), ["task", "split", "label_tactic"])


@register
def random_split(spark, sf_dir):
    """No row is lost or doubled, and the share of each side is about right."""
    train, test = X.random_split(table(spark, sf_dir, "events").select("event_id", "event_type"))
    both = train.withColumn("__train", F.lit(1)).unionByName(test.withColumn("__train", F.lit(0)))
    return both.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("event_id").alias("ids"),
        F.avg("__train").between(0.5, 0.9).alias("share_in_range"),
    )


# --- features ------------------------------------------------------------------------------


@register
def feature_projection(spark, sf_dir):
    how = policy("corrected", labels=("event_id", "event_type"))
    return feature_frame(table(spark, sf_dir, "events"), how, keep=("event_id", "event_type"))


@register
def blank_handling(spark, sf_dir):
    language = (
        F.when(F.col("lang") == "de", F.lit(None))
        .when(F.col("lang") == "fr", F.lit("  "))
        .otherwise(F.col("lang"))
    )
    values = table(spark, sf_dir, "documents").select(
        F.col("lang"),
        text_value(language, mark_blank=False).alias("legacy"),
        text_value(language, mark_blank=True).alias("corrected"),
    )
    return X.class_counts(values, ["lang", "legacy", "corrected"])


@register
def impute_and_scale(spark, sf_dir):
    """Quantities count as missing where no discount was given; prices stay as they are."""
    quantity = F.when(F.col("l_discount") > 0, F.col("l_quantity"))
    lines = table(spark, sf_dir, "lineitem").select(
        *LINE_KEY, *LINE_TIES, quantity.alias("quantity"), "l_extendedprice", "l_tax"
    )
    how = policy("corrected", labels=(*LINE_KEY, *LINE_TIES))
    model = fit_features(lines, how)
    scaled = model.transform(lines, (*LINE_KEY, *LINE_TIES))
    return _spread(scaled, ["quantity", "l_extendedprice", "l_tax"])


def _spread(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """Vector slots as rounded columns."""
    slots = vector_to_array("features")
    kept = [c for c in df.columns if c != "features"]
    wide = df.select(*kept, slots.alias("__x"))
    return wide.select(
        *kept, *[F.round(F.col("__x")[i], digits).alias(n) for i, n in enumerate(names)]
    )


@register
def string_index(spark, sf_dir):
    return P.category_index(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@register
def index_lookup(spark, sf_dir):
    """Brands indexed on small parts, looked up for all parts; rare values by a second join."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    index = P.category_index(parts.filter("p_size <= 10"), ["p_name"])
    return P.index_column(parts, "p_name", P.lookup(index, "p_name", head=8), "name_index")


@register
def one_hot(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    model = fit_features(parts, policy("corrected", labels=("p_partkey",)), scale=False)
    slots = vector_to_array("features")
    return model.transform(parts, ("p_partkey",)).select(
        "p_partkey",
        (F.array_position(slots, F.lit(1.0)) - 1).alias("slot"),
        F.size(slots).cast("bigint").alias("width"),
    )


@register
def unseen_categories(spark, sf_dir):
    both = X.hash_split(table(spark, sf_dir, "customer"), ["c_custkey"], kind="md5")
    train, test = both.filter("split = 'train'"), both.filter("split = 'test'")
    return P.unseen_categories(train, test, ["c_name", "c_mktsegment"])


@register
def unseen_by_filter(spark, sf_dir):
    """Unseen categories by way of a membership filter."""
    both = X.hash_split(table(spark, sf_dir, "customer"), ["c_custkey"], kind="md5")
    train, test = both.filter("split = 'train'"), both.filter("split = 'test'")
    return P.unseen_by_filter(train, test, ["c_name", "c_mktsegment"])


@register
def hash_load(spark, sf_dir):
    load = P.hash_load(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])
    return load.withColumn("distinct_values", F.to_json("distinct_values"))


@register
def hash_collisions(spark, sf_dir):
    """Names and segments of customers that share a slot of the feature hasher."""
    return P.hash_collisions(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@register
def hashed_features(spark, sf_dir):
    """Rows per bucket of two columns hashed into one vector."""
    how = policy("hashed-ips", labels=("c_custkey",), addresses=("c_name", "c_mktsegment"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    model = fit_features(customers, how, scale=False)
    hashed = model.transform(customers, ("c_custkey",))
    hits = hashed.agg(vector_to_array(Summarizer.sum(F.col("features"))).alias("hits"))
    return hits.select(F.posexplode("hits").alias("bucket", "hits")).withColumn(
        "hits", F.rint("hits").cast("bigint")  # a summarizer goes by way of the mean
    )


@register
def hashed_feature_totals(spark, sf_dir):
    """Every row hits one bucket per hashed column."""
    hits = hashed_features(spark, sf_dir)
    return hits.agg(
        F.count(F.lit(1)).alias("buckets"),
        F.sum("hits").alias("hits"),
        F.min("hits").alias("least"),
    ).select("buckets", "hits", (F.col("least") >= 0).alias("none_negative"))


@register
def feature_vectors(spark, sf_dir):
    """The whole pipeline: fitted on the train side of ``orders``, applied to the test side."""
    both = X.hash_split(table(spark, sf_dir, "orders"), ["o_orderkey"], kind="md5")
    train, test = (both.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    model = fit_features(train, policy("corrected", labels=("o_orderkey", "o_orderstatus")))
    slots = [f"f{i}" for i in range(model.dimension)]
    return _spread(model.transform(test, ("o_orderkey",)), slots)


# --- metrics -------------------------------------------------------------------------------


def rule_predictions(spark, sf_dir):
    """Every task of ``events`` with a rule in place of a model."""
    frames = build_task_frames(event_flows(spark, sf_dir), [EVENTS])
    binary = (F.col("value") > 20).cast("double")
    many = F.least(F.floor(F.col("value") / 15).cast("double"), F.lit(4.0))
    return frames.withColumn(
        "prediction", F.when(F.col("kind") == "binary", binary).otherwise(many)
    )


def _rule_confusion(spark, sf_dir):
    labels = task_labels(spark, [EVENTS]).drop("dataset")
    return M.confusion(rule_predictions(spark, sf_dir), labels, ["task"])


@register
def confusion_matrix(spark, sf_dir):
    return _rule_confusion(spark, sf_dir)


@register
def confusion_nested(spark, sf_dir):
    cells = _rule_confusion(spark, sf_dir)
    nested = M.matrix_table(cells, M.per_class(cells, ["task"]), ["task"])
    return nested.select(
        "task",
        F.to_json("matrix").alias("matrix"),
        F.to_json(F.transform("per_class", lambda c: c["support"])).alias("supports"),
    )


@register
def per_class_metrics(spark, sf_dir):
    return rounded(M.per_class(_rule_confusion(spark, sf_dir), ["task"]))


def _rule_summary(spark, sf_dir):
    return M.summary(M.per_class(_rule_confusion(spark, sf_dir), ["task"]), ["task"])


@register
def metric_summary(spark, sf_dir):
    return rounded(
        _rule_summary(spark, sf_dir).drop(
            "per_class_fpr_json", "collapse_flag", "collapse_reason",
            "evaluation_valid", "evaluation_warning",
        )
    )


@register
def collapse_and_validity(spark, sf_dir):
    """A rule that never predicts the attack, on a split in which one class has no rows."""
    frames = rule_predictions(spark, sf_dir).withColumn(
        "prediction", F.when(F.col("task") == "error", 0.0).otherwise(F.col("prediction"))
    )
    frames = frames.filter("NOT (task = 'signup' AND label_tactic = 'signup')")
    labels = task_labels(spark, [EVENTS]).drop("dataset")
    cells = M.confusion(frames, labels, ["task"])
    return M.summary(M.per_class(cells, ["task"]), ["task"]).select(
        "task", "collapse_flag", "collapse_reason", "evaluation_valid", "evaluation_warning",
        "test_rows",
    )


@register
def auroc_binary(spark, sf_dir):
    frames = build_task_frames(event_flows(spark, sf_dir), [EVENTS]).filter("kind = 'binary'")
    return rounded(M.auroc(frames, F.col("value"), F.col("label") == 1.0, ["task"]), digits=9)


@register
def auroc_interval(spark, sf_dir):
    """Exact AUROC of the binary tasks, and whether the interval of a merged state holds it and is narrow.

    The state of one half of the events has the bins; the other half is counted under them."""
    frames = build_task_frames(event_flows(spark, sf_dir), [EVENTS]).filter("kind = 'binary'")
    scored = A.scored_rows(frames, F.col("value"), F.col("label") == 1.0, ["task", "event_id"])
    scored = scored.withColumn("identity", F.to_json(F.struct("task")))
    halves = [scored.filter(F.col("event_id") % 2 == i).drop("event_id") for i in (0, 1)]
    first, edges = A.fit_state(halves[0], ["task"], width=1e-3)
    found = A.bounds(A.merged([first, A.histogram(halves[1], edges, ["task"])], ["task"]), ["task"])
    exact = M.auroc(frames, F.col("value"), F.col("label") == 1.0, ["task"]).select("task", "auroc")
    held = (F.col("auroc") >= F.col("lower") - 1e-12) & (F.col("auroc") <= F.col("upper") + 1e-12)
    return exact.join(found, "task").select(
        "task", F.round("auroc", 9).alias("auroc"), held.alias("held"), (F.col("width") < 0.01).alias("narrow")
    )


@register
def auroc_skewed_scores(spark, sf_dir):
    """Few distinct scores, one of them in a third of the rows."""
    lines = table(spark, sf_dir, "lineitem")
    score = F.when(F.col("l_quantity") <= 17, 0.0).otherwise(F.col("l_discount"))
    out = M.auroc(lines, score, F.col("l_returnflag") == "R", ["l_linestatus"])
    return rounded(out, digits=9)


def _embedding_scores(spark, sf_dir):
    """The score of a class is the greatest of the slots whose number ends in its digit."""
    slots = F.col("embedding").cast("array<double>")
    every = [
        F.greatest(*[F.get(slots, F.lit(i)) for i in range(digit, 64, 10)]) for digit in range(10)
    ]
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("double").alias("label"), F.array(*every).alias("scores")
    )


CLASSES = [float(i) for i in range(10)]


@register
def auroc_by_class(spark, sf_dir):
    scored = _embedding_scores(spark, sf_dir)
    return rounded(M.auroc_one_vs_rest(scored, F.col("scores"), CLASSES), "auroc", digits=9)


@register
def auroc_weighted(spark, sf_dir):
    per_class = M.auroc_one_vs_rest(_embedding_scores(spark, sf_dir), F.col("scores"), CLASSES)
    return rounded(M.weighted_auroc(per_class, CLASSES), digits=9)


# --- reductions and models -----------------------------------------------------------------


def _line_vectors(spark, sf_dir, *columns, keep=()):
    lines = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "N", 0.0).when(F.col("l_returnflag") == "A", 1.0)
    return lines.select(
        *keep,
        label.otherwise(2.0).alias("label"),
        array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("features"),
    )


@register
def class_moments(spark, sf_dir):
    moments = R.class_moments(_line_vectors(spark, sf_dir, "l_quantity", "l_discount", "l_tax"))
    means = vector_to_array("mean")
    return moments.select(
        "label", "n", *[F.round(means[i], 6).alias(f"mean{i}") for i in range(3)]
    )


@register
def class_scatter(spark, sf_dir):
    df = _line_vectors(spark, sf_dir, "l_quantity", "l_discount", "l_tax")
    lines = R.scatter_table(spark, R.fit_scatter(df))
    return lines.select("line", *[F.round(F.col("values")[i], 4).alias(f"c{i}") for i in range(3)])


@register
def pca_variance(spark, sf_dir):
    df = _line_vectors(spark, sf_dir, "l_quantity", "l_linenumber")
    return rounded(R.variance_table(spark, R.fit_pca(df, 2).explainedVariance))


@register
def pca_spread(spark, sf_dir):
    """Variance of each projected component, which does not depend on its sign."""
    df = _line_vectors(spark, sf_dir, "l_quantity", "l_linenumber")
    return rounded(_slot_variance(R.pca_project(df, R.fit_pca(df, 2), 2)))


def _slot_variance(df):
    """Variance of each slot of the features, combined on the executors."""
    spread = df.agg(vector_to_array(Summarizer.variance(F.col("features"))).alias("v"))
    slots = spread.select(F.posexplode("v").alias("i", "variance"))
    return slots.select((F.col("i") + 1).alias("component"), "variance")


@register
def lda_variance(spark, sf_dir):
    df = _line_vectors(spark, sf_dir, "l_quantity", "l_linenumber")
    return rounded(R.variance_table(spark, R.fit_lda(df, 2).ratios), digits=5)


@register
def lda_projection(spark, sf_dir):
    """Scores of the one discriminant of two classes and two features, for every row."""
    keep = [*LINE_KEY, *LINE_TIES]
    df = _line_vectors(spark, sf_dir, "l_quantity", "l_linenumber", keep=keep)
    df = df.withColumn("label", (F.col("label") > 0).cast("double"))
    scores = R.lda_project(df, R.fit_lda(df, 1), 1)
    return _spread(scores.drop("label"), ["score"], digits=5)


def _embedding_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("label").cast("double").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )


@register
def pca_embeddings(spark, sf_dir):
    df = _embedding_vectors(spark, sf_dir)
    return R.variance_table(spark, R.fit_pca(df, 11).explainedVariance)


@register
def pca_total_spread(spark, sf_dir):
    """All components together keep the variance of the embedding."""
    df = _embedding_vectors(spark, sf_dir)
    spread = _slot_variance(R.pca_project(df, R.fit_pca(df, 64), 64))
    return rounded(
        spread.agg(F.count(F.lit(1)).alias("components"), F.sum("variance").alias("variance"))
    )


@register
def pca_agreement(spark, sf_dir):
    """Explained variance times total variance is the variance of the projected component."""
    df = _embedding_vectors(spark, sf_dir)
    model = R.fit_pca(df, 11)
    total = _slot_variance(df).agg(F.sum("variance")).first()[0]
    explained = R.variance_table(spark, model.explainedVariance)
    both = explained.join(_slot_variance(R.pca_project(df, model, 11)), "component")
    gap = F.abs(F.col("explained_variance") * total - F.col("variance"))
    return both.select(
        F.col("component").cast("bigint").alias("component"),
        (gap < 1e-8 * total).alias("agrees"),
    )


@register
def lda_beyond_rank(spark, sf_dir):
    """Three classes, two features of which one is constant: one direction, the rest is zero."""
    lines = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(1.0))
    label = F.when(F.col("l_returnflag") == "N", 0.0).when(F.col("l_returnflag") == "A", 1.0)
    df = lines.select(
        label.otherwise(2.0).alias("label"),
        array_to_vector(F.array(F.col("l_quantity").cast("double"), "constant")).alias("features"),
    )
    model = R.fit_lda(df, 2)
    scores = R.lda_project(df, model, 2)
    spread = rounded(_slot_variance(scores), digits=4)
    return R.variance_table(spark, model.ratios).join(spread, "component").select(
        F.col("component").cast("bigint").alias("component"),
        F.round("explained_variance", 6).alias("explained_variance"),
        "variance",
    )


@register
def lda_embeddings(spark, sf_dir):
    df = _embedding_vectors(spark, sf_dir)
    return R.variance_table(spark, R.fit_lda(df, 9, "whiten").ratios)


#: Iterations of the study's protocol.
ITERATIONS = Protocol.resolve("corrected").svm_max_iter


def _sides(df: DataFrame, key: str):
    both = X.hash_split(df, [key], kind="md5")
    return [both.filter(F.col("split") == s).drop("split") for s in ("train", "test")]


@contextmanager
def _trained_on(df: DataFrame, row_bytes: int):
    """Training rows cached for the passes of an iterative fit, in as few partitions as fit."""
    cached = df.select("label", "features").cache()
    try:
        yield compact(cached, cached.count(), row_bytes)
    finally:
        cached.unpersist()


def _share(of: Column, text: Column) -> Column:
    """Share of the characters of ``text`` that match a class of characters."""
    return F.length(F.regexp_replace(text, of, "")) / F.greatest(F.length(text), F.lit(1))


def _text_features(text: str) -> list[Column]:
    """Numbers that describe a whole text: its size, words, lines, repetition, and kinds of characters."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words, lines = F.split(whole, "[ \\n\\t]+"), F.split(whole, "\\n")
    return [
        F.length(whole).alias("characters"),
        F.size(words).alias("words"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_words"),
        (F.size(F.array_distinct(lines)) / F.size(lines)).alias("distinct_lines"),
        (F.length(whole) / F.size(words)).alias("word_length"),
        (F.length(whole) / F.size(lines)).alias("line_length"),
        _share("[^0-9]", whole).alias("digits"),
        _share("[^A-Z]", whole).alias("capitals"),
        _share("[^.,;:!?]", whole).alias("marks"),
        _share("[^#$%&*+/<=>@\\\\^_{|}~]", whole).alias("symbols"),
    ]


def _quality_features(spark, sf_dir):
    """Quality labels of documents with features of their whole texts, language and source."""
    # texts are read once, before anything is shuffled; the numbers are kept for the fits
    described = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", *_text_features("text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    labelled = durable(described.join(labels, "doc_id"))
    train, test = _sides(labelled, "doc_id")
    model = fit_features(train, policy("corrected", labels=("doc_id", "label")))
    return model.transform(train, ("label",)), model.transform(test, ("label",))


@register
def svm_binary(spark, sf_dir):
    train, test = _quality_features(spark, sf_dir)
    with _trained_on(train, 512) as rows:
        predictions = V.predict(V.fit_svm(rows, "binary", ITERATIONS), test)
    predictions = predictions.withColumn("task", F.lit("quality"))
    cells = M.confusion(predictions, [0, 1], ["task"])
    score = V.evaluate_auroc(predictions, [0.0, 1.0], ["task"])
    return M.summary(M.per_class(cells, ["task"]), ["task"]).join(score, "task")


@register
def svm_ovr(spark, sf_dir):
    train, test = _sides(_embedding_vectors(spark, sf_dir), "vec_id")
    with _trained_on(train, 1024) as rows:
        predictions = V.predict(V.fit_svm(rows, "multinomial", ITERATIONS), test)
    return M.per_class(M.confusion(predictions, CLASSES))


@register
def svm_least_loss(spark, sf_dir):
    """Return flags by the line number alone: the least loss of each flag against the others, which is taken where
    two groups of lines lie on their margins, and whether the fitted machine gets there."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("double").alias("x"))
    flags = ["A", "N", "R"]
    label = F.array_position(F.array(*map(F.lit, flags)), F.col("l_returnflag")) - 1
    train = lines.select(label.cast("double").alias("label"), array_to_vector(F.array("x")).alias("features"))
    model = V.fit_svm(train, "multinomial", ITERATIONS)
    fitted = local_table(spark, [(c, f.loss) for c, f in zip(flags, model.fits)], "flag string, loss double")
    # at most a row for each flag and line number
    counts = F.broadcast(side_table(lines.groupBy("l_returnflag", "x").agg(F.count(F.lit(1)).alias("n"))))
    rows = counts.crossJoin(F.broadcast(local_table(spark, [(c,) for c in flags], "flag string"))).select(
        "flag", "x", F.when(F.col("l_returnflag") == F.col("flag"), 1).otherwise(-1).alias("y"), "n"
    ).groupBy("flag", "x", "y").agg(F.sum("n").alias("n"))
    a, b = (rows.select("flag", F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i in (1, 2))
    slope = (F.col("y1") - F.col("y2")) / (F.col("x1") - F.col("x2"))
    tried = a.join(b, "flag").filter("x1 < x2").select("flag", slope.alias("w"), (F.col("y1") - slope * F.col("x1")).alias("b"))
    flat = a.select("flag", F.lit(0.0).alias("w"), F.col("y1").cast("double").alias("b"))
    lack = F.greatest(F.lit(0.0), 1 - F.col("y") * (F.col("x") * F.col("w") + F.col("b")))
    losses = tried.unionByName(flat).distinct().join(rows, "flag").groupBy("flag", "w", "b").agg(
        (F.sum(F.col("n") * lack) / F.sum("n")).alias("loss")
    )
    least = losses.groupBy("flag").agg(F.min("loss").alias("least"))
    reached = F.col("loss") <= F.col("least") * 1.001
    return least.join(fitted, "flag").select("flag", F.round("least", 6).alias("least"), reached.alias("reached"))


@register
def svm_supports(spark, sf_dir):
    """Rows per class on the test side, as the models above report them."""
    binary = svm_binary(spark, sf_dir).select(F.lit("quality").alias("task"), "test_rows")
    many = svm_ovr(spark, sf_dir).agg(F.sum("support").alias("test_rows"))
    return binary.unionByName(many.select(F.lit("embeddings").alias("task"), "test_rows"))


@register
def svm_separable(spark, sf_dir):
    """Two classes that a line tells apart are told apart without a mistake."""
    lines = table(spark, sf_dir, "lineitem").select(
        *LINE_KEY,
        (F.col("l_quantity") > 25).cast("double").alias("label"),
        array_to_vector(
            F.array(
                F.when(F.col("l_quantity") > 25, 5.0).otherwise(-5.0) + F.col("l_discount"),
                F.col("l_tax").cast("double"),
            )
        ).alias("features"),
    )
    both = X.hash_split(lines, LINE_KEY, kind="md5")
    train, test = (both.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    with _trained_on(train, 64) as rows:
        predictions = V.predict(V.fit_svm(rows, "binary", ITERATIONS), test)
    cells = M.confusion(predictions, [0, 1])
    return M.summary(M.per_class(cells)).select("accuracy", "test_rows")


@register
def svm_diagnostics(spark, sf_dir):
    train, _ = _quality_features(spark, sf_dir)
    with _trained_on(train, 512) as rows:
        return V.diagnostics(spark, V.fit_svm(rows, "binary", ITERATIONS), ITERATIONS)


@register
def svm_sweep(spark, sf_dir):
    train, test = _quality_features(spark, sf_dir)
    with _trained_on(train, 512) as rows:
        swept, _ = V.sweep(rows, test, "binary")
    keys = ["svm_max_iter", "svm_threshold"]
    return M.summary(M.per_class(M.confusion(swept, [0, 1], keys), keys), keys)


@register
def experiment_metrics(spark, sf_dir):
    """Sample, split, features, reductions, models and metrics of all tasks of ``events``, end to end."""
    flows = event_flows(spark, sf_dir).withColumnRenamed("event_id", "uid")
    flows = flows.withColumn("k", F.get_json_object("props", "$.k").cast("int")).drop("props")
    return run(flows, EVENTS, Protocol.resolve("corrected"))["metrics"]


@register
def experiment_metrics_paper(spark, sf_dir):
    """The same by the study's own method; ``props`` is a text column with an ordinal index."""
    flows = event_flows(spark, sf_dir).withColumnRenamed("event_id", "uid")
    return run(flows, EVENTS, Protocol.resolve("paper-compatible"))["metrics"]


# --- comparison ----------------------------------------------------------------------------

#: Model variants of the comparison queries: method, components, cut on the event value.
MODELS = (("minimal", None, 30.0), ("pca", 1, 10.0), ("pca", 2, 1000.0), ("lda", 1, 40.0))


def _model_results(spark, sf_dir):
    """Threshold models of the binary event tasks with their metrics on either split."""
    flows = X.hash_split(event_flows(spark, sf_dir), ["event_id"], kind="md5")
    frames = build_task_frames(flows, [EVENTS]).filter("kind = 'binary'")
    models = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(method).alias("preprocessing"),
                    F.lit(k).cast("int").alias("k"),
                    F.lit(cut).alias("cut"),
                )
                for method, k, cut in MODELS
            ]
        )
    )
    scored = frames.select("dataset", "task", "split", "label", "value", models.alias("m")).select(
        "dataset", "task", "split", "label", "value", "m.preprocessing", "m.k",
        (F.col("value") > F.col("m.cut")).cast("double").alias("prediction"),
    )
    by = ["split", *C.MODEL]
    results = M.summary(M.per_class(M.confusion(scored, [0, 1], by), by), by)
    return scored, side_table(results)  # one row per model, read several times


def _comparison_parts(spark, sf_dir):
    """Published cells, metrics and timings: results on the train side stand for the published ones."""
    scored, results = _model_results(spark, sf_dir)
    published = C.long_metrics(results.filter("split = 'train'")).select(
        *C.MODEL, "metric", F.col("value").alias("paper_value"), F.lit("fraction").alias("unit")
    )
    seconds = (
        scored.filter("split = 'train'")
        .groupBy(*C.MODEL)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*C.MODEL, F.explode(F.array(*[F.lit(m) for m in _SECONDS])).alias("metric"), "n")
        .select(
            *C.MODEL,
            "metric",
            (F.col("n") / 100).alias("paper_value"),
            F.lit("seconds").alias("unit"),
        )
    )
    erratum = (F.col("metric") == "weighted_f1") & (F.col("task") == "click")
    reference = published.unionByName(seconds).withColumn(
        "status", F.when(erratum, F.lit("excluded")).otherwise(F.lit("valid"))
    )
    timings = scored.filter("split = 'test'").select(
        *C.MODEL,
        F.col("value").alias("preprocessing_seconds"),
        (F.col("value") * 2).alias("training_seconds"),
        F.lit(None).cast("double").alias("evaluation_seconds"),
    )
    metrics = results.filter("split = 'test'").drop("split")
    return reference, metrics, timings


def _comparison(spark, sf_dir):
    """Results on the test side against those on the train side."""
    reference, metrics, timings = _comparison_parts(spark, sf_dir)
    return C.compare(reference, metrics, None, timings), metrics


_SECONDS = (
    "preprocessing_seconds", "cpu_training_seconds", "gpu_training_seconds",
    "cpu_testing_seconds", "cpu_mr_training_seconds",
)


@register
def comparison_status(spark, sf_dir):
    cells, _ = _comparison(spark, sf_dir)
    return rounded(cells)


def _filled(df, schema):
    """``df`` with the columns of ``schema``, null where it has none."""
    fields = T.StructType.fromDDL(schema).fields
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


@register
def published_audit(spark, sf_dir):
    """A run written as files, found complete by its manifest, read back, audited, and the audit read back."""
    reference, metrics, timings = _comparison_parts(spark, sf_dir)
    tables = {"metrics": _filled(metrics, METRIC_SCHEMA), "timings": _filled(timings, TIMING_SCHEMA)}
    manifest = {"config": {"method": "corrected", "profile": "full"}}
    base = publish_run(spark, tables, _shared_folder(spark, "runs"), "run", manifest)
    cells = audit_run(spark, base, reference)["paper_comparison"]
    protocol = read_table(spark, f"{base}/audit_protocol", "setting string, value string")
    method = protocol.filter("setting = 'method'").select(F.col("value").alias("method"))
    back = read_table(spark, f"{base}/paper_comparison", cells.schema)
    # CSV has one form for null and for empty text, which is what cells without a grade have
    back = back.withColumn("grade", F.coalesce("grade", F.lit("")))
    return rounded(back).crossJoin(F.broadcast(method))


@register
def error_summary(spark, sf_dir):
    return rounded(C.error_summary(_comparison(spark, sf_dir)[0]))


@register
def error_by_group(spark, sf_dir):
    return rounded(C.error_by_group(_comparison(spark, sf_dir)[0]))


@register
def chart_published(spark, sf_dir):
    return rounded(C.chart_published(_comparison(spark, sf_dir)[0]))


@register
def best_accuracy(spark, sf_dir):
    _, results = _model_results(spark, sf_dir)
    return rounded(C.best_accuracy(results.filter("split = 'test'")))


@register
def chart_accuracy_by_k(spark, sf_dir):
    _, results = _model_results(spark, sf_dir)
    return rounded(C.chart_accuracy_by_k(results.filter("split = 'test'")))


@register
def collapsed_models(spark, sf_dir):
    _, results = _model_results(spark, sf_dir)
    return C.collapsed_models(results.filter("split = 'test'"))


@register
def metrics_long(spark, sf_dir):
    _, results = _model_results(spark, sf_dir)
    return rounded(C.long_metrics(results.filter("split = 'test'")))


@register
def chart_counts(spark, sf_dir):
    return C.chart_counts(_stacked_census(spark, sf_dir, CENSUS_LABELS))


def _line_variance(spark, sf_dir, wanted="true"):
    """Share of each line number in the lines of a year: years as fits, line numbers as
    components."""
    lines = table(spark, sf_dir, "lineitem").filter(wanted).select(
        F.col("l_returnflag").alias("dataset"),
        F.lit("pca").alias("preprocessing"),
        F.col("l_linestatus").alias("task"),
        F.year("l_shipdate").alias("k"),
        F.col("l_linenumber").alias("component"),
    )
    by = [*C.MODEL, "component"]
    counted = X.class_counts(lines, by)
    totals = counted.groupBy(*C.MODEL).agg(F.sum("n").alias("__all"))
    return counted.join(totals, C.MODEL).select(
        *by, (F.col("n") / F.col("__all")).alias("explained_variance")
    )


@register
def cumulative_variance(spark, sf_dir):
    return rounded(R.cumulative_variance(_line_variance(spark, sf_dir), C.MODEL))


@register
def max_k_rows(spark, sf_dir):
    variance = R.cumulative_variance(_line_variance(spark, sf_dir), C.MODEL)
    return rounded(C.max_k_rows(variance, ["dataset", "preprocessing", "task"]))


@register
def variance_long(spark, sf_dir):
    variance = R.cumulative_variance(_line_variance(spark, sf_dir), C.MODEL)
    return rounded(C.long_variance(variance))


@register
def chart_variance(spark, sf_dir):
    variance = R.cumulative_variance(_line_variance(spark, sf_dir), C.MODEL)
    return rounded(C.chart_variance(variance))


@register
def variance_errors(spark, sf_dir):
    """Variance of all lines against that of the lines with a small discount as the published one."""
    published, variance = (
        R.cumulative_variance(_line_variance(spark, sf_dir, wanted), C.MODEL)
        for wanted in ("l_discount <= 0.05", "true")
    )
    reference = C.long_variance(published).select(
        *C.MODEL,
        "metric",
        F.col("value").alias("paper_value"),
        F.lit("fraction").alias("unit"),
        F.lit("valid").alias("status"),
    )
    metrics = spark.createDataFrame([], METRIC_SCHEMA)
    return rounded(C.error_by_group(C.compare(reference, metrics, variance)))


def _line_timings(spark, sf_dir):
    """Line items as timing observations; the first line number stands for no components."""
    number = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset"),
        F.col("l_linestatus").alias("task"),
        F.concat(F.lit("m"), number % 3).alias("preprocessing"),
        F.when(number > 1, number).alias("k"),
        F.col("l_extendedprice").alias("base_preprocessing_seconds"),
        F.col("l_quantity").alias("dimensionality_reduction_seconds"),
        F.col("l_quantity").alias("training_seconds"),
        F.col("l_discount").alias("prediction_seconds"),
        F.col("l_tax").alias("metric_seconds"),
    )


@register
def timing_medians(spark, sf_dir):
    return rounded(C.long_timings(C.timing_rows(_line_timings(spark, sf_dir))))


@register
def timing_ranks(spark, sf_dir):
    phases = ["preprocessing_seconds", "training_seconds"]
    return rounded(C.timing_ranks(C.timing_rows(_line_timings(spark, sf_dir)), phases))


@register
def ranking_text(spark, sf_dir):
    ranks = C.timing_ranks(C.timing_rows(_line_timings(spark, sf_dir)), ["preprocessing_seconds"])
    return C.ranking_text(ranks)


@register
def chart_phases(spark, sf_dir):
    return rounded(C.chart_phases(C.timing_rows(_line_timings(spark, sf_dir))))
