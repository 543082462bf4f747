"""Secret scans, exact duplicates and shards against brute force."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from flowmark.llm import exact_dedup, kd_shards, secrets

from .tables import awkward, awkward_rows, empty

PATTERNS = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)


def spans(text):
    found = [
        (m.start(), i, f"{kind}:{m.start()}:{m.end()}")
        for i, (kind, pattern, group, least) in enumerate(PATTERNS)
        for m in re.finditer(pattern, text or "")
        if len(m[group]) >= least
    ]
    return ",".join(s for _, _, s in sorted(found))


def test_secrets_by_brute_force(spark):
    rows = secrets.findings_by_path(secrets.scan(awkward(spark))).collect()
    assert len(rows) == len(awkward_rows())
    found = sorted((r.doc_id, r.spans) for r in rows if r.doc_id is not None)
    assert found == sorted((r[0], spans(r[1])) for r in awkward_rows() if r[0] is not None)


def test_a_ledger_spares_known_blobs(spark):
    old = spark.createDataFrame([(1, "token=abcdefgh"), (2, "plain")], "doc_id long, text string")
    first = secrets.scan(old)
    new = old.unionByName(
        spark.createDataFrame([(3, "plain"), (4, "x token=abcdefghi")], old.schema)
    )
    second = secrets.scan(new, first.ledger, first.findings)
    assert second.ledger.count() == 3 * 3 == second.ledger.distinct().count()
    # a finding the ledger says is known is not looked for again
    blind = secrets.scan(new, first.ledger)
    assert blind.findings.count() == 1
    by_path = {r.doc_id: r.spans for r in secrets.findings_by_path(second).collect()}
    assert by_path == {1: "assign:0:14", 2: "", 3: "", 4: "assign:2:17"}
    # a new version of one rule is scanned everywhere, the others nowhere
    rules = (secrets.BASE_RULES[0]._replace(version="2"), *secrets.BASE_RULES[1:])
    third = secrets.scan(new, second.ledger, second.findings, rules=rules)
    assert third.ledger.count() == 3 * 3 + 3
    assert {r.doc_id: r.spans for r in secrets.findings_by_path(third, rules).collect()} == by_path


def test_hidden_secrets_leave_the_rest(spark):
    shown = secrets.without_secrets(awkward(spark))
    assert shown.columns == awkward(spark).columns
    texts = {r.doc_id: r.text for r in shown.collect() if r.doc_id is not None}
    for doc_id, text, *_ in awkward_rows():
        if doc_id is not None and not spans(text):
            assert texts[doc_id] == text
    assert texts[6] == "[secret] and [secret]' token = short [secret]"
    assert texts[7] == "[secret] [secret] AKIA12 deadbeef"


def test_exact_duplicates_by_brute_force(spark):
    rows = exact_dedup.exact_duplicates(awkward(spark)).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in awkward_rows():
        groups[text or ""].append(doc_id)
    assert len(rows) == len(awkward_rows())
    for r in rows:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(groups[text])
        assert r.keep_id == max((i for i in groups[text] if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in rows) == len(groups)


def test_smallest_id_and_many_rounds(spark):
    docs = spark.createDataFrame(
        [(i, f"t{i % 7}") for i in range(200)], "doc_id long, text string"
    ).repartition(40)
    rows = exact_dedup.exact_duplicates(docs, keep="smallest").collect()
    assert {(r.doc_id, r.keep_id) for r in rows} == {(i, i % 7) for i in range(200)}
    kept = exact_dedup.without_duplicates(docs, keep="smallest").collect()
    assert sorted(r.doc_id for r in kept) == list(range(7))


def check_shards(rows, n, shards, limit):
    assert len(rows) == n
    slots, sizes, homes = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert set(slots) <= set(range(shards))
    mean = sum(sizes.values()) / shards
    assert max(sizes.values()) <= limit * mean and min(sizes.get(s, 0) for s in range(shards)) >= mean / limit
    return homes


def test_shards_have_equal_bytes(spark):
    docs = spark.range(4000).selectExpr(
        "id AS doc_id",
        "repeat('ab', cast(10 + id % 90 as int)) || (id div 2) AS text",
        "cast(id % 5 as string) AS lang",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 11 as string) END AS source",
        "id % 90 AS n_chars",
    )
    rows = kd_shards.kd_shards(docs, ("n_chars", "source", "lang", "doc_id"), n_shards=24).collect()
    homes = check_shards(rows, 4000, 24, 1.03)
    assert all(len(h) == 1 for h in homes.values())


def test_a_group_of_a_third_is_divided(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id",
        "CASE WHEN id % 3 = 0 THEN repeat('hot', 30) ELSE repeat('x', 80) || id END AS text",
        "cast(null as string) AS lang",
    )
    rows = kd_shards.kd_shards(docs, ("lang", "doc_id"), n_shards=8).collect()
    homes = check_shards(rows, 3000, 8, 1.05)
    assert sum(len(h) > 1 for h in homes.values()) == 1


def test_shards_of_awkward_rows(spark):
    rows = kd_shards.kd_shards(awkward(spark), ("n_chars", "lang"), target_bytes=50_000).collect()
    assert len(rows) == len(awkward_rows())
    assert {r.size for r in rows if r.doc_id in (0, 1)} == {8}


def test_no_rows(spark):
    assert secrets.findings_by_path(secrets.scan(empty(spark))).count() == 0
    assert secrets.without_secrets(empty(spark)).count() == 0
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    assert kd_shards.kd_shards(empty(spark), ("n_chars",), n_shards=4).count() == 0


def test_parts_in_turn_find_what_one_scan_finds(spark):
    docs = awkward(spark)
    names = ["doc_id", "blob", "n_assign", "n_access", "n_hex", "spans"]
    whole = secrets.findings_by_path(secrets.scan(docs)).select(*names)
    parts = [docs.filter(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == i) for i in range(3)]
    turns = secrets.scan_in_turn([*parts, empty(spark)]).select(*names)
    assert sorted(map(str, turns.collect())) == sorted(map(str, whole.collect()))
    again = secrets.scan_in_turn([docs, docs]).select(*names)
    assert again.count() == 2 * whole.count() and again.distinct().count() == whole.distinct().count()
