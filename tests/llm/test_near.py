"""Near-duplicates against all pairs by brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from flowmark.llm import chosen_path
from flowmark.llm import components as component_steps
from flowmark.llm.components import components

from .tables import awkward, awkward_rows, empty, words


def brute_force(rows, k, percent):
    def shingles(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", text)
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i]]
        least = min((x for x in ids if x is not None), default=None)
        out.append((r[0], len(sets[i]), least))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [4, 5])
def test_awkward_rows(spark, k):
    near = chosen_path.near_duplicates(awkward(spark), k)
    assert found(near) == brute_force(awkward_rows(), k, 80)
    assert near.filter("kept").count() == len(
        chosen_path.without_near_duplicates(awkward(spark), k).collect()
    )


def chains(n, seed):
    """Texts that change step by step, so that groups hang together by links close to the limit."""
    rng = random.Random(seed)
    rows, text = [], words(120, seed)
    for i in range(n):
        if rng.random() < 0.15:
            text = words(rng.randrange(3, 200), seed * 1000 + i)
        text = list(text)
        for _ in range(rng.randrange(0, 3)):
            text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [(32, 200_000, 1000, 2000, 1500), (3, 5, 0, 4, 20)])
def test_chains_with_small_limits(spark, monkeypatch, small):
    node, pairs, row_pairs, part, block = small
    monkeypatch.setattr(chosen_path, "ROW_PAIRS", row_pairs)
    monkeypatch.setattr(chosen_path, "PART", part)
    monkeypatch.setattr(chosen_path, "SMALL_NODE", node)
    monkeypatch.setattr(chosen_path, "NODE_PAIRS", pairs)
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    rows = chains(500, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(chosen_path.near_duplicates(docs, 4)) == brute_force(rows, 4, 80)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    wanted = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 300: 200}
    assert {r.v: r.root for r in rows} == wanted and len(rows) == len(wanted)


def test_sketches_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = chosen_path._sketches([np.unique(base[:2000]), np.unique(base[500:2500])])
    assert abs((a == b).mean() - 0.6) < 0.25


def test_no_rows(spark):
    assert chosen_path.near_duplicates(empty(spark)).count() == 0


def stages_of(spark, run):
    """Stages that ran for ``run``."""
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    infos = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("counted")]
    ran = {s for info in infos if info for s in info.stageIds}
    return sum(1 for s in ran if (x := tracker.getStageInfo(s)) and x.numCompletedTasks)


def test_links_take_few_stages(spark):
    # a path whose ids are shuffled, in five parts, and a star
    order = random.Random(3).sample(range(1000), 1000)
    links = [*zip(order, order[1:]), *((2000, i) for i in range(2001, 2100))]
    table = spark.createDataFrame(links, "a long, b long").repartition(5)
    rows = []
    ran = stages_of(spark, lambda: rows.extend(components(table).collect()))
    assert {r.v: r.root for r in rows} == dict.fromkeys(range(1000), 0) | dict.fromkeys(range(2000, 2100), 2000)
    assert len(rows) == 1100 and ran <= 70, ran


def test_near_duplicates_take_few_stages(spark):
    rows = chains(300, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = []
    ran = stages_of(spark, lambda: out.extend(found(chosen_path.near_duplicates(docs, 4))))
    assert out == brute_force(rows, 4, 80) and ran <= 190, ran


@pytest.mark.parametrize("most", [1, 40])
def test_components_of_links_connected_few_at_a_time(spark, monkeypatch, most):
    monkeypatch.setattr(component_steps, "LINKS", most)
    monkeypatch.setattr(component_steps, "release", lambda spark: None)
    rng = random.Random(most)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)]
    links += [(i + 1, i) for i in range(100, 130)] + [(5, None), (None, None), (700, 700)]
    root = {v: v for v in {x for a, b in links if None not in (a, b) and a != b for x in (a, b)}}
    for _ in root:
        for a, b in links:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.v: r.root for r in rows} == root and len(rows) == len(root)


def test_star_of_links_in_any_order():
    a, b = [7, 5, 5, 9, 1, 3], [5, 7, 3, 9, 2, 2]
    star = component_steps._star([pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])])
    assert dict(zip(*(c.to_pylist() for c in star.columns))) == {1: 1, 2: 1, 3: 1, 5: 1, 7: 1, 9: 9}


@pytest.mark.parametrize("together", [1, 2, 256])
def test_sets_are_confirmed_exactly(monkeypatch, together):
    monkeypatch.setattr(chosen_path, "TOGETHER", together)
    monkeypatch.setattr(chosen_path, "AGREE", 0)
    rng = np.random.default_rng(4)
    base = np.sort(rng.choice(1 << 62, 60, replace=False).astype(np.uint64))
    sets = [base[:9], base[1:10], base[:8], base[20:21], base[20:21], base[30:39], base[30:32]]
    sets += [np.sort(rng.choice(base, rng.integers(40, 60), replace=False)) for _ in range(25)]
    group = pd.DataFrame({"cls": range(len(sets)), "own": 0, "shingles": [s.tobytes() for s in sets]})
    links = chosen_path._confirm(0.8)(group)
    linked = {frozenset(x) for x in links.itertuples(index=False)}
    wanted, group_of = [], list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            wanted.append(frozenset((i, j)))
            group_of = [group_of[i] if g == group_of[j] else g for g in group_of]
    assert linked <= set(wanted) and frozenset((0, 1)) in wanted
    assert len(linked) == len(sets) - len(set(group_of))  # a forest of all groups
