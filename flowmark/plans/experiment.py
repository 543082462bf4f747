"""The whole study: tasks, samples, splits, features, reductions, models, metrics, timings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from time import perf_counter

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructField, StructType

from flowmark.fixed_values import CLASS_CAP, PCA_GRID, SWEEP_ITERATIONS, SWEEP_THRESHOLDS
from flowmark.functions.blocks import packed, vector_rows
from flowmark.functions.durable import bounded_table, compact, durable, local_table, null_safe_join
from flowmark.operators import metrics as M
from flowmark.operators.compare import timing_rows
from flowmark.operators.features import (
    METADATA_SCHEMA,
    PREFIX,
    FeatureModel,
    FeaturePolicy,
    feature_frame,
    fit_features,
    policy,
)
from flowmark.operators.profile import hash_load, unseen_categories
from flowmark.operators.margins import Variant, View, fit_machines, scores
from flowmark.operators.reduction import (
    cumulative_variance,
    matrices_fit,
    pca_of,
    scatter_of,
    solve_lda,
    wide_lda_of,
)
from flowmark.operators.sampling import (
    class_counts,
    sample_for_run,
    sample_policy,
    split_for_run,
    union_all,
)
from flowmark.operators.svm import DIAGNOSTIC_SCHEMA, SvmModel, diagnostic_rows, evaluate_auroc, task_machines
from flowmark.operators.tasks import DatasetSpec, Protocol, build_task_frame, variants
from flowmark.plans.audit import IDENTITY_SCHEMA
from flowmark.sources.scan import require_valid

IDENTITY = [item.split()[0] for item in IDENTITY_SCHEMA.split(", ")]
PLACE_SCHEMA = "dataset string, task string, stage string"
KNOWN_SCHEMAS = {
    "not_fitted": f"{PLACE_SCHEMA}, missing_label double",
    "class_counts": f"{PLACE_SCHEMA}, split string, label_tactic string, n bigint",
    "preprocessing": f"{PLACE_SCHEMA}, sampling map<string,string>, {METADATA_SCHEMA}",
    "variance": f"{IDENTITY_SCHEMA}, component int, explained_variance double",
    "timings": f"{IDENTITY_SCHEMA}, repetition int, base_preprocessing_seconds double,"
    " dimensionality_reduction_seconds double, training_seconds double,"
    " prediction_seconds double, metric_seconds double",
    "model_diagnostics": f"{IDENTITY_SCHEMA}, {DIAGNOSTIC_SCHEMA}",
    "sweep_diagnostics": f"{IDENTITY_SCHEMA}, {DIAGNOSTIC_SCHEMA}",
}


@dataclass(frozen=True)
class RunConfig:
    """What to run and how."""

    stages: tuple[str, ...] = ("minimal", "pca", "lda")
    profile: str = "full"
    cap: int = CLASS_CAP
    repetitions: int = 1
    warmup: bool = False
    pca_grid: tuple[int, ...] = PCA_GRID
    diagnostic_sweep: bool = False
    sweep_iterations: tuple[int, ...] = SWEEP_ITERATIONS
    sweep_thresholds: tuple[float, ...] = SWEEP_THRESHOLDS
    lda_normalise: str = "unit"
    key_cols: tuple[str, ...] = ("uid",)
    fallback_cols: tuple[str, ...] | None = None
    label_col: str = "label_tactic"
    policy: FeaturePolicy | None = None  # instead of the protocol's policy by name


@dataclass
class _Group:
    """Rows of the stages of a task that share their features, and the models to be fitted on them."""

    number: int
    rows: DataFrame  # packed; those of the train side are group 2 * number, those of the test side the next
    width: int
    kind: str
    labels: list[float]
    base_seconds: float
    views: list[View] = field(default_factory=list)
    #: identity, view, columns and seconds of the reduction of every model
    models: list[tuple[dict, int, int, float]] = field(default_factory=list)


#: Columns that hold labels in one form or another.
TARGETS = ("label", "label_binary", "label_technique")


def _fallback(frame: DataFrame, config: RunConfig) -> Sequence[str] | None:
    """Columns that stand in for a null key: those of the configuration, else all others with a text
    form, by name. They are only read where the key column has nulls."""
    if config.fallback_cols is not None or len(config.key_cols) > 1:
        return config.fallback_cols
    (key,) = config.key_cols
    if frame.filter(F.col(key).isNull()).limit(1).isEmpty():
        return None
    others = [c for c in frame.columns if c not in (key, config.label_col, *TARGETS)]
    return sorted(c for c in others if isinstance(frame.schema[c].dataType, AtomicType))


class _Results:
    """Result tables of many models, stacked at the end.

    What is added is computed at once, so nothing depends on training data that has been
    released. Tables of few rows are kept as such; larger ones go to the checkpoint folder.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.small: dict[str, list[pa.Table]] = {}
        self.large: dict[str, list[DataFrame]] = {}
        self.known: dict[str, list[tuple]] = {}
        self.schemas: dict[str, StructType] = {}

    def add(self, name: str, table: DataFrame, identity: dict) -> None:
        types = dict(item.split() for item in IDENTITY_SCHEMA.split(", "))
        columns = [F.lit(v).cast(types.get(c, "string")).alias(c) for c, v in identity.items()]
        table = table.select(*columns, "*")
        rows = bounded_table(table)
        if rows is None:
            self.large.setdefault(name, []).append(durable(table))
        else:
            fields = [StructField(f.name, f.dataType) for f in table.schema.fields]
            self.schemas[name] = StructType(fields)
            self.small.setdefault(name, []).append(rows)

    def add_rows(self, name: str, rows: Sequence[tuple], identity: dict) -> None:
        start = tuple(identity.values())
        self.known.setdefault(name, []).extend((*start, *row) for row in rows)

    def tables(self) -> dict[str, DataFrame]:
        parts = {name: list(frames) for name, frames in self.large.items()}
        for name, rows in self.small.items():
            stacked = pa.concat_tables(rows, promote_options="permissive")
            parts.setdefault(name, []).append(
                self.spark.createDataFrame(stacked, self.schemas[name])
            )
        for name, rows in self.known.items():
            parts.setdefault(name, []).append(
                self.spark.createDataFrame(rows, KNOWN_SCHEMAS[name])
            )
        return {name: union_all(frames) for name, frames in parts.items()}


def run(
    flows: DataFrame,
    spec: DatasetSpec,
    protocol: Protocol,
    config: RunConfig = RunConfig(),
    problems: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Run all tasks and stages on one labelled table and return the result tables.

    The features of every task are fitted first and stay cached; then the models of all tasks, stages and
    classes are fitted in the same passes, and judged in one. A ``full`` run is refused if ``problems`` of the
    inventory is not empty.
    """
    if config.profile == "full" and problems is not None:
        require_valid(problems)
    results = _Results(flows.sparkSession)
    groups: list[_Group] = []
    held: list[DataFrame] = []
    try:
        for task, kind, _ in spec.tasks():
            mapping = spec.label_mapping(task)
            frame = build_task_frame(flows, mapping, config.label_col)
            # stages that see the same sample and scaling share the features fitted on it
            shared: dict[tuple, list[str]] = {}
            for stage in config.stages:
                how = sample_policy(
                    dataset=spec.name,
                    stage=stage,
                    task=task,
                    profile=config.profile,
                    method=protocol.method,
                    cap=config.cap,
                )
                key = (*how.values(), protocol.scales(stage))
                shared.setdefault(key, []).append(stage)
            for stages in shared.values():
                group = _prepare(
                    results, held, len(groups), frame, spec, protocol, config, task, kind, mapping, stages
                )
                if group is not None:
                    groups.append(group)
        if any(g.models for g in groups):
            _fit_and_measure(results, [g for g in groups if g.models], protocol, config)
    finally:
        for table in held:
            table.unpersist()
    tables = results.tables()
    confusions = tables.pop("confusion")
    classes = M.per_class(confusions, IDENTITY)
    summary = M.summary(classes, IDENTITY)
    tables["metrics"] = null_safe_join(summary, tables.pop("auroc"), IDENTITY, "left")
    mappings = flows.sparkSession.createDataFrame(
        [(spec.name, task, spec.label_mapping(task)) for task, _, _ in spec.tasks()],
        "dataset string, task string, label_mapping map<string,double>",
    )
    tables["confusion"] = M.matrix_table(confusions, classes, IDENTITY).join(
        F.broadcast(mappings), ["dataset", "task"]
    )
    tables["timings"] = timing_rows(tables["timings"])
    if "variance" in tables:
        tables["variance"] = cumulative_variance(tables["variance"], IDENTITY)
    if "sweep_confusion" in tables:
        keys = [*IDENTITY, "svm_max_iter", "svm_threshold"]
        swept = M.summary(M.per_class(tables.pop("sweep_confusion"), keys), keys)
        tables["diagnostic_sweeps"] = null_safe_join(
            swept, tables.pop("sweep_auroc"), keys, "left"
        )
    return tables


def _prepare(
    results: _Results,
    held: list[DataFrame],
    number: int,
    frame: DataFrame,
    spec: DatasetSpec,
    protocol: Protocol,
    config: RunConfig,
    task: str,
    kind: str,
    mapping: dict[str, float],
    stages: Sequence[str],
) -> _Group | None:
    """Sample, split, features and reductions of the stages of a task; ``None`` if a label has no training rows.

    What is cached is added to ``held``.
    """
    spark = frame.sparkSession
    labels = sorted(mapping.values())
    keys = {"key_cols": config.key_cols, "fallback_cols": _fallback(frame, config)}
    places = [{"dataset": spec.name, "task": task, "stage": stage} for stage in stages]
    identities = {
        stage: {
            "dataset": spec.name,
            "task": task,
            "task_kind": kind,
            "method": protocol.method,
            "profile": config.profile,
            "preprocessing": stage,
            "k": None,
            "engine": "spark-scatter" if stage == "lda" else "spark",
            "execution_mode": "spark",
            "accelerator": "cpu",
            "distributed": not spark.sparkContext.master.startswith("local"),
        }
        for stage in stages
    }
    sample, sampling = sample_for_run(
        frame,
        dataset=spec.name,
        stage=stages[0],
        task=task,
        profile=config.profile,
        method=protocol.method,
        cap=config.cap,
        seed=protocol.seed,
        label=config.label_col,
        **keys,
    )
    if config.profile == "development":  # at most ``cap`` rows per class, read many times
        held.append(sample.persist(StorageLevel.MEMORY_AND_DISK))
    elif "target_rows" in sampling and protocol.method != "corrected":
        # a random split is only sound on partitions that stay as they are
        sample = durable(sample)
    sides = split_for_run(
        sample,
        dataset=spec.name,
        task=task,
        method=protocol.method,
        seed=protocol.seed,
        **keys,
    )
    train, test = (
        sides.filter(F.col("split") == side).drop("split") for side in ("train", "test")
    )
    # two rows per declared class
    counts = class_counts(sides, ["split", config.label_col, "label"]).collect()
    for place in places:
        rows = [(r["split"], r[config.label_col], r["n"]) for r in counts]
        results.add_rows("class_counts", rows, place)
    present = {r["label"] for r in counts if r["split"] == "train"}
    absent = [x for x in labels if x not in present]
    if absent:
        # without a model nothing is predicted: an empty matrix, reported as not valid
        nothing = spark.createDataFrame([], "label double, prediction double")
        for stage, place in zip(stages, places):
            results.add_rows("not_fitted", [(x,) for x in absent], place)
            results.add("confusion", M.confusion(nothing, labels), identities[stage])
        return None
    how = config.policy or policy(
        protocol.feature_policy,
        labels=(*config.key_cols, "uid", config.label_col, *TARGETS),
    )
    started = perf_counter()
    fit_frame = sample if protocol.fit_on_all else train
    model = fit_features(
        fit_frame, how, protocol.scales(stages[0]), protocol.preprocessing_fit_scope
    )
    # both sides come from one scan and stay in one cached table
    side = 2 * number + F.when(F.col("split") == "train", 0).otherwise(1)
    rows = packed(vector_rows(model.transform(sides, ("label", "split")), side)).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(rows)
    # computed in the partitions of the source, before its blocks are merged for the fits; so the
    # timing covers the transform
    rows.count()
    rows = compact(rows, sum(r["n"] for r in counts), 8 * model.dimension + 64)
    base_seconds = perf_counter() - started
    _describe(results, model, how, train, test, fit_frame, sampling, protocol, places)
    group = _Group(number, rows, model.dimension, kind, labels, base_seconds)
    for stage in stages:
        _reduce(results, group, stage, identities[stage], len(mapping), protocol, config)
    return group


def _describe(
    results: _Results,
    model: FeatureModel,
    how: FeaturePolicy,
    train: DataFrame,
    test: DataFrame,
    fit_frame: DataFrame,
    sampling: dict,
    protocol: Protocol,
    places: Sequence[dict],
) -> None:
    """Record how the features were made: mappings, unseen values, hash load."""
    spark = train.sparkSession
    policy_used = {name: str(value) for name, value in sampling.items()}
    described = {"string_index": model.mapping_table(spark)}
    if not protocol.fit_on_all and model.columns.indexed:
        described["unseen_categories"] = unseen_categories(
            feature_frame(train, how, ()),
            feature_frame(test, how, ()),
            [PREFIX + c for c in model.columns.indexed],
        ).withColumn("column", F.expr(f"substring(column, {len(PREFIX) + 1})"))
    if model.columns.hashed:
        described["hash_load"] = hash_load(fit_frame, list(model.columns.hashed), how.buckets)
    for place in places:
        results.add_rows("preprocessing", [(policy_used, *model.metadata_row())], place)
    for name, table in described.items():
        # one table for the stages that share it
        stages = F.array(*[F.lit(p["stage"]) for p in places])
        first = {"dataset": places[0]["dataset"], "task": places[0]["task"]}
        results.add(name, table.withColumn("stages", stages), first)


def _reduce(
    results: _Results,
    group: _Group,
    stage: str,
    identity: dict,
    classes: int,
    protocol: Protocol,
    config: RunConfig,
) -> None:
    """Models of a stage: one reduction is fitted, and every component count uses its first columns.

    Projections are made while training rows are read, so no projected table is kept.
    """
    counts = variants(stage, classes, group.width, config.pca_grid)
    if not counts:
        return
    started = perf_counter()
    rows = group.rows if protocol.fit_on_all else _side([group], "train")
    ratios: Sequence[float] = []
    if stage == "minimal":
        group.views.append(View())
    elif stage == "pca":
        model = pca_of(rows, group.width, max(counts))
        ratios = list(model.ratios)
        group.views.append(View(model.components))
    else:
        if matrices_fit(group.width):
            model = solve_lda(scatter_of(rows, group.width), max(counts), config.lda_normalise)
        else:
            model = wide_lda_of(rows, group.width, group.labels, max(counts), config.lda_normalise)
        ratios = list(model.ratios)
        group.views.append(View(model.projection, model.mean))
    seconds = 0.0 if stage == "minimal" else perf_counter() - started
    for k in counts:
        own = {**identity, "k": k}
        results.add_rows("variance", [(i, float(x)) for i, x in enumerate(ratios[:k] if k else [], 1)], own)
        group.models.append((own, len(group.views) - 1, k or group.width, seconds))


def _side(groups: Sequence[_Group], side: str) -> DataFrame:
    """The packed rows of one side, under the numbers of their groups."""
    last = 0 if side == "train" else 1
    own = [g.rows.filter(F.col("group") == 2 * g.number + last) for g in groups]
    return union_all(own).withColumn("group", F.expr("group div 2").cast("int"))


def _fit_and_measure(
    results: _Results, groups: Sequence[_Group], protocol: Protocol, config: RunConfig
) -> None:
    """Fit the models of all groups together and measure each on the test rows of its group.

    Time spent on all models together is divided among them, training by their numbers of weights.
    """
    train, test = (_side(groups, side) for side in ("train", "test"))
    views = {g.number: g.views for g in groups}
    widths = {g.number: g.width for g in groups}
    machines, judged, models = [], [], []
    for g in groups:
        for identity, view, width, seconds in g.models:
            own = task_machines(g.kind, g.labels, g.number, view, width)
            threshold = protocol.svm_threshold if g.kind == "binary" else None
            judged.append(Variant(g.number, tuple(range(len(machines), len(machines) + len(own))), threshold))
            models.append((identity, g, seconds))
            machines += own
    weights = [sum(machines[m].width + 1 for m in v.machines) for v in judged]
    for repetition in range(0 if config.warmup else 1, config.repetitions + 1):
        started = perf_counter()
        fits = fit_machines(train, views, widths, machines, protocol.svm_max_iter)
        fitted = perf_counter()
        predictions = scores(test, views, machines, fits, judged).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            predictions.count()
            predicted = perf_counter()
            if repetition == config.repetitions:
                names = _identities(results.spark, [identity for identity, _, _ in models])
                groups_of = [g for _, g, _ in models]
                collapsed = _measure(results, predictions, groups_of, names, "confusion", "auroc", IDENTITY)
        finally:
            predictions.unpersist()
        measured = perf_counter()
        if repetition == 0:
            continue
        for (identity, g, seconds), own in zip(models, weights):
            parts = (
                (fitted - started) * own / sum(weights),
                (predicted - fitted) / len(models),
                (measured - predicted) / len(models),
            )
            results.add_rows("timings", [(repetition, g.base_seconds, seconds, *parts)], identity)
    for (identity, _, _), v in zip(models, judged):
        model = SvmModel(tuple(machines[m] for m in v.machines), tuple(fits[m] for m in v.machines), v.threshold)
        results.add_rows("model_diagnostics", diagnostic_rows(model, protocol.svm_max_iter), identity)
    if config.diagnostic_sweep and collapsed:
        chosen = [(models[i][0], models[i][1], [machines[m] for m in judged[i].machines]) for i in collapsed]
        _sweep(results, train, test, views, widths, chosen, config)


def _identities(spark: SparkSession, identities: Sequence[dict], more: str = "", values: Sequence[tuple] = ()) -> DataFrame:
    """Identity of every variant by its number, with further columns if wanted."""
    rows = [(i, *own.values(), *(values[i] if values else ())) for i, own in enumerate(identities)]
    return local_table(spark, rows, f"variant int, {IDENTITY_SCHEMA}{more}")


def _measure(
    results: _Results,
    predictions: DataFrame,
    groups: Sequence[_Group],
    names: DataFrame,
    confusion: str,
    auroc: str,
    keys: Sequence[str],
) -> list[int]:
    """Confusion and AUROC of all variants, which belong to ``groups``; returns the collapsed ones."""
    spark = results.spark
    labels = local_table(spark, [(i, g.labels) for i, g in enumerate(groups)], "variant int, labels array<double>")
    # a variant without test rows has its zeros too
    zeros = [(i, a, b, 0) for i, g in enumerate(groups) for a in g.labels for b in g.labels]
    cells = M.confusion(predictions, labels, ["variant"]).unionByName(
        local_table(spark, zeros, "variant int, label double, prediction double, n bigint")
    )
    cells = cells.groupBy("variant", "label", "prediction").agg(F.sum("n").alias("n"))
    cells = durable(cells)  # a row for every variant and pair of labels
    flags = M.summary(M.per_class(cells, ["variant"]), ["variant"]).filter("collapse_flag").select("variant")
    collapsed = [r["variant"] for r in flags.collect()]
    results.add(confusion, cells.join(F.broadcast(names), "variant").select(*keys, "label", "prediction", "n"), {})
    for wanted in sorted({tuple(g.labels) for g in groups}):
        own = [i for i, g in enumerate(groups) if tuple(g.labels) == wanted]
        found = evaluate_auroc(predictions.filter(F.col("variant").isin(own)), wanted, ["variant"])
        results.add(auroc, found.join(F.broadcast(names), "variant").select(*keys, "auroc"), {})
    return sorted(collapsed)


def _sweep(
    results: _Results,
    train: DataFrame,
    test: DataFrame,
    views: dict[int, list[View]],
    widths: dict[int, int],
    chosen: Sequence[tuple],
    config: RunConfig,
) -> None:
    """Settings sweep of collapsed models in one fit; the faithful results stay as they are."""
    machines = [m for _, _, own in chosen for m in own]
    fits = fit_machines(
        train, views, widths, machines, max(config.sweep_iterations), config.sweep_iterations
    )
    known, snapshots, judged, settings, groups, first = [], [], [], [], [], 0
    for identity, g, own in chosen:
        for max_iter in config.sweep_iterations:
            mine = tuple(f.snapshots[max_iter] for f in fits[first : first + len(own)])
            model = SvmModel(tuple(own), mine, 0.0 if g.kind == "binary" else None)
            results.add_rows("sweep_diagnostics", diagnostic_rows(model, max_iter), identity)
            at = tuple(range(len(known), len(known) + len(own)))
            known += own
            snapshots += mine
            for threshold in config.sweep_thresholds:
                judged.append(Variant(g.number, at, threshold if g.kind == "binary" else None))
                settings.append((identity, (max_iter, threshold)))
                groups.append(g)
        first += len(own)
    swept = scores(test, views, known, snapshots, judged).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        names = _identities(
            results.spark,
            [identity for identity, _ in settings],
            ", svm_max_iter int, svm_threshold double",
            [own for _, own in settings],
        )
        keys = [*IDENTITY, "svm_max_iter", "svm_threshold"]
        _measure(results, swept, groups, names, "sweep_confusion", "sweep_auroc", keys)
    finally:
        swept.unpersist()


def run_all(
    sources: dict[str, DataFrame],
    specs: Sequence[DatasetSpec],
    protocol: Protocol,
    config: RunConfig = RunConfig(),
    problems: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """:func:`run` over several datasets, result tables stacked."""
    runs = [run(sources[spec.name], spec, protocol, config, problems) for spec in specs]
    names = sorted({name for tables in runs for name in tables})
    return {name: union_all([t[name] for t in runs if name in t]) for name in names}
