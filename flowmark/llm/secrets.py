"""Secret scans with a ledger of blobs, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds the pairs
of blob and rule version that were scanned before; only pairs it does not hold are scanned, each
distinct blob once however many paths have it. Findings belong to blobs and are joined back to
all paths. Scanning again after a change of one rule scans only that rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmark.functions.durable import durable
from flowmark.llm.common import stored, texts


class Rule(NamedTuple):
    kind: str
    version: str
    pattern: str
    #: group whose length counts (0: the whole match) and its least length
    group: int
    least: int


# fixed values: the base rules, in the order in which ties of position are listed
BASE_RULES = (
    Rule(
        "assign",
        "1",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", "1", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "1", r"[0-9a-f]{32,}", 0, 32),
)
LEDGER = "blob string, kind string, version string"
FINDINGS = "blob string, kind string, version string, start long, end long"


class Scan(NamedTuple):
    paths: DataFrame  # doc_id, row, blob, n_chars
    ledger: DataFrame
    findings: DataFrame


def _matches(text, rule: Rule):
    """What is needed to place the matches of a rule: lengths of the matches, of the group that counts
    and of the text before each match. Null where nothing matches, after one look at the text."""
    lengths = lambda a: F.transform(a, F.char_length)
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("width"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("counted"),
        F.slice(
            lengths(F.split(text, rule.pattern, -1)),
            1,
            F.size(F.regexp_extract_all(text, pattern, F.lit(0))),
        ).alias("gap"),
    )
    return F.when(text.rlike(rule.pattern), found)


def _pending(paths: DataFrame, ledger: DataFrame | None, rules) -> DataFrame:
    """Distinct blobs with their text and the kinds that were not scanned yet."""
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    current = F.concat_ws(" ", "kind", "version").isin([f"{r.kind} {r.version}" for r in rules])
    done = ledger.filter(current).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    return (
        blobs.join(done, "blob", "left")
        .withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
        .drop("done")
        .filter(F.size("todo") > 0)
    )


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    findings: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = BASE_RULES,
) -> Scan:
    """Scan the versions (``id_col`` is the path; a path may have many rows) against a ledger.

    Returns the paths with their blobs, and ledger and findings with what is new added. A null text
    is an empty blob, which holds no finding. Repeated rows share a blob. Positions count code
    points and ends are exclusive. Matches of a rule do not overlap, the leftmost counts, and
    one whose counted group is too short is dropped after it was matched. Tables of no rows give
    tables of no rows.
    """
    paths = texts(versions, id_col, text_col).withColumn("blob", F.sha2("text", 256))
    pending = _pending(paths, ledger, rules)
    entries = [
        F.struct(
            F.lit(r.kind).alias("kind"),
            F.lit(r.version).alias("version"),
            F.lit(r.least).alias("least"),
            F.when(F.array_contains("todo", r.kind), _matches(F.col("text"), r)).alias("found"),
        )
        for r in rules
    ]
    order = Window.partitionBy("blob", "kind").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        pending.select("blob", F.explode(F.array(*entries)).alias("e"))
        .select("blob", "e.kind", "e.version", "e.least", F.posexplode("e.found").alias("k", "m"))
        .select("blob", "kind", "version", "least", "k", "m.*")
        .withColumn(
            "start",
            F.coalesce(F.sum(F.col("gap") + F.col("width")).over(before), F.lit(0)) + F.col("gap"),
        )
        .filter("counted >= least")
        .select("blob", "kind", "version", "start", (F.col("start") + F.col("width")).alias("end"))
    )
    versions_of = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    seen = pending.select("blob", F.explode("todo").alias("kind")).select(
        "blob", "kind", versions_of[F.col("kind")].alias("version")
    )
    if ledger is not None:
        seen = ledger.select(*T.StructType.fromDDL(LEDGER).names).unionByName(seen)
    if findings is not None:
        placed = findings.select(*T.StructType.fromDDL(FINDINGS).names).unionByName(placed)
    return Scan(paths.drop("text"), seen, placed)


def scan_in_turn(
    parts: Sequence[DataFrame],
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = BASE_RULES,
) -> DataFrame:
    """:func:`findings_by_path` of tables that come one after the other. Ledger and findings of each are stored
    before the next is scanned, which then scans only blobs that none before it had."""
    ledger, findings, paths = None, None, []
    for part in parts:
        result = scan(part, ledger, findings, id_col, text_col, rules)
        ledger, findings = stored(result.ledger), stored(result.findings)
        paths.append(result.paths)
    found = durable(by_blob(findings, rules))
    whole = paths[0]
    for more in paths[1:]:
        whole = whole.unionByName(more)
    return _on_paths(whole, found, rules)


def by_blob(findings: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Per blob: ``n_<kind>``, and ``spans``, a text of kind:start:end by start, then kind as listed.

    Only findings of the current version of a rule count.
    """
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    current = F.concat_ws(" ", "kind", "version").isin([f"{r.kind} {r.version}" for r in rules])
    ordered = F.array_sort(
        F.collect_list(F.struct("start", place[F.col("kind")].alias("place"), "kind", "end"))
    )
    return (
        findings.filter(current)
        .groupBy("blob")
        .agg(
            *[
                F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}")
                for r in rules
            ],
            F.transform(
                ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
            ).alias("found"),
        )
        .withColumn(
            "spans",
            F.array_join(
                F.transform(
                    "found",
                    lambda s: F.concat_ws(
                        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
                    ),
                ),
                ",",
            ),
        )
    )


def findings_by_path(result: Scan, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """One row per path and version: ``doc_id``, ``row``, ``blob``, counts, ``found``, ``spans``."""
    # kept first: the join then only shuffles its sides, and Spark can split a blob of many paths
    return _on_paths(result.paths, durable(by_blob(result.findings, rules)), rules)


def _on_paths(paths: DataFrame, found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    counts = [f"n_{r.kind}" for r in rules]
    return paths.join(found, "blob", "left").select(
        "doc_id",
        "row",
        "blob",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        "found",
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def hide(text, found, mask: str):
    """``text`` with the spans of ``found`` (in order of their start, null: none) replaced by ``mask``;
    spans that overlap become one mask."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, span):
        new = F.concat(
            state["out"],
            F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0))),
            F.lit(mask),
        )
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(span["start"] >= state["at"], new).otherwise(state["out"]).alias("out"),
        )

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text)))
    return F.when(found.isNull(), text).otherwise(F.aggregate(found, begin, step, rest))


def without_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mask: str = "[secret]",
    rules: tuple[Rule, ...] = BASE_RULES,
) -> DataFrame:
    """All rows and columns of ``docs`` with their secrets replaced by ``mask``. Null texts stay null."""
    found = durable(
        by_blob(scan(docs, None, None, id_col, text_col, rules).findings, rules).select(
            F.col("blob").alias("__blob"), F.col("found").alias("__found")
        )
    )
    marked = docs.withColumn("__key", F.sha2(text_col, 256))
    return (
        marked.join(found, F.col("__key") == F.col("__blob"), "left")
        .withColumn(text_col, hide(F.col(text_col), F.col("__found"), mask))
        .drop("__key", "__blob", "__found")
    )
