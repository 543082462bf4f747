"""The prefix trie and the repair of conversations against brute force."""

import heapq
import random
import re
import zlib
from hashlib import sha256
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from flowmark.llm import prefix_trie, turns
from flowmark.llm.queries import op11_prefix_trie, op12_structure_repair

SCHEMA = "conv_id long, turn long, role string, text string, conv long, depth int, gone int, seen int, n long"


def order(row):
    conv, turn, role, text = row
    return turn is not None, turn or 0, role, text


def conversations(rows, missing):
    """Rows by conversation, in order, nulls as ``missing``."""
    plain = [(c, t, missing if r is None else r, missing if x is None else x) for c, t, r, x, *_ in rows]
    found = {}
    for row in sorted(plain, key=order):
        found.setdefault(row[0], []).append(row)
    return found


# --- trie ----------------------------------------------------------------------------------


def brute_trie(rows):
    by_conv = {c: [(r, x) for _, _, r, x in own] for c, own in conversations(rows, "").items() if c is not None}
    whole = {}
    for c, own in by_conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(by_conv.get(base, [])[:h] + own[h:])
    members = {}
    for c, own in whole.items():
        for d in range(len(own) + 1):
            members.setdefault(own[:d], []).append(c)
    children, out = {}, []
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        stack, found = [node], []
        while stack:
            found.append(stack.pop())
            stack += children.get(found[-1], [])
        return found

    for node, own in members.items():
        tree = below(node)
        ends = ",".join(str(c) for c in sorted(own) if whole[c] == node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in tree if x)
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])),
            sum(x not in children for x in tree), saved, sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: r[:2])


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r) for r in op11_prefix_trie(spark, path).select(*TRIE).collect()), key=lambda r: r[:2])


def talks(n, seed, most=9, of=3):
    """Conversations of few different turns, so that they share beginnings; some equal, one long."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        role, copies = ["user", "assistant", "system"], rng.randrange(of)
        for t in range(rng.randrange(0, most)):
            rows.append((c, t, role[t % 2], f"té{rng.randrange(2) if t else copies}."))
    rows += [(n, t, "user", f"x{t}") for t in range(60)]
    return rows


def test_trie(spark, tmp_path):
    rows = talks(120, 5)
    assert found_trie(spark, rows, tmp_path) == brute_trie(rows)


def test_trie_in_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = talks(60, 6, most=14)
    assert found_trie(spark, rows, tmp_path) == brute_trie(rows)


def test_trie_of_nested_conversations(spark, tmp_path):
    # every conversation goes on where the one before ends, so a single chain runs through all paths
    rows = [(5 * c, t, "u", f"{t}") for c in range(24) for t in range(c)]
    own = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)
    numbered = prefix_trie.numbered(own)
    nodes, ends = prefix_trie.prefix_trie(numbered, numbered.select("conv").distinct())
    got = {(r.conv, r.depth): (r.n_convs, r.leaves, r.saved) for r in nodes.collect()}
    weights = [(23 - max(d, 1)) * len(str(d - 1)) if d else 0 for d in range(24)]
    names = {d: (5 * max(d, 1), d) for d in range(24)}
    assert got == {names[d]: (24 - max(d, 1), 1, sum(weights[d:])) for d in range(24)}
    assert sorted(tuple(r) for r in ends.collect()) == [(5 * c, c, 5 * c) for c in range(1, 24)]


def test_trie_with_nulls_ties_and_repeated_rows(spark, tmp_path):
    rows = [
        (0, None, "user", "first"), (0, 3, None, None), (0, 3, None, None), (0, 3, "a", ""), (0, 1, "", "x" * 70_000),
        (1, 0, "user", "first"), (5, 0, "user", None), (6, 0, "b", "a"), (6, 0, "a", "b"), (-3, 1, "user", "é"),
        (None, 0, "user", "nobody's"), (7, 2, "ab", "c"), (8, 2, "a", "bc"),
    ]
    got, wanted = found_trie(spark, rows, tmp_path), brute_trie(rows)
    # turns with one number and role come by the digest of their text, so only names and counts are compared
    assert [r[:7] for r in got] == [r[:7] for r in wanted]


def test_trie_of_no_rows(spark, tmp_path):
    assert found_trie(spark, [], tmp_path) == []


# --- repair --------------------------------------------------------------------------------


def brute_damage(rows):
    out = []
    for c, t, r, x, *_ in rows:
        c_text, t_text = (" " if v is None else str(v) for v in (c, t))
        kind = zlib.crc32(f"{c_text}:{t_text}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(own):
    seen, found = set(), []
    for _, _, role, text in own:
        words = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not words else "duplicate" if (role, text) in seen else None
        found.append(fault or (None if words[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return found


def cheapest(own, marks):
    """Uniform-cost search over edits; the first sound end has the least cost, and the least letters of those."""
    heap, sound, done = [(0, "", 0, ())], re.compile(r"(s?(ua)+)?"), set()
    prefix = re.compile(r"(s?(ua)*u?)?")
    while heap:
        cost, letters, i, kept = heapq.heappop(heap)
        roles = "".join(role[:1] for role, _ in kept)
        if i == len(own) and sound.fullmatch(roles):
            return cost, letters, "\n".join(f"{role}:{text}" for role, text in kept)
        state = (i, roles[-1:])
        if state in done or not prefix.fullmatch(roles):
            continue
        # the first to come here is the cheapest and least by letters
        done.add(state)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, letters + "I", i, (*kept, (role, ""))))
        if i < len(own):
            _, _, role, text = own[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, kept))
            if marks[i] not in ("blank", "duplicate"):
                short = marks[i] == "truncated"
                heapq.heappush(heap, (cost + short, letters + "K", i + 1, (*kept, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + short, letters + "R", i + 1, (*kept, (other, text))))
    raise AssertionError


def brute_repair(rows):
    after = conversations(brute_damage(rows), " ")
    out = []
    for c in {r[0] for r in rows}:
        own = after.get(c, [])
        marks, known = faults(own), [t for _, t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, text = cheapest(own, marks)
        out.append((
            c, gaps, *[marks.count(f) for f in turns.FAULTS], sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, sha256(text.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found_repair(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    names = ["conv_id", "gaps", *turns.FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in op12_structure_repair(spark, path).select(*names).collect()), key=str)


def quarrels(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "and", "", " \n", "Why?\t ", "same.", None, "é."]
    return [
        (c, rng.choice([t, t, t, t + rng.randrange(4), None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"{t}.")
        for c in range(n)
        for t in range(rng.randrange(0, 8))
    ]


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_repair(spark, tmp_path, batch):
    rows = quarrels(150, 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert found_repair(spark, rows, tmp_path) == brute_repair(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repair_with_nulls_ties_repeats_and_a_long_conversation(spark, tmp_path):
    rows = [(None, t, "user", "a.") for t in range(3)] + [(9, None, None, None)] * 3
    rows += [(10, 1, "user", "b."), (10, 1, "user", "a."), (10, 1, "assistant", "a.")]
    rows += [(11, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"{t // 3}.") for t in range(300)]
    rows += [(12, 0, "user", "x" * 300_000), (12, 1, "assistant", " " * 300_000)]
    assert found_repair(spark, rows, tmp_path) == brute_repair(rows)


def test_edits_give_the_reported_text(spark):
    rows = quarrels(60, 8)
    own = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)
    edits = {}
    for r in turns.repaired(own, missing=" ").orderBy("conv_id", "position").collect():
        edits.setdefault(r.conv_id, []).append(r)
    for r in turns.repair_report(own, missing=" ").collect():
        mine = edits.get(r.conv_id, [])
        assert "".join(e.edit for e in mine) == r.audit
        text = "\n".join(f"{e.role}:{e.text}" for e in mine if e.edit != "D")
        assert sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_repair_of_no_rows(spark, tmp_path):
    assert found_repair(spark, [], tmp_path) == []
    assert turns.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
