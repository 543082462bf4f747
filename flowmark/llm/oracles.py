"""The queries of this folder in DuckDB SQL, where SQL can express them."""

_PIECES = """
    SELECT doc_id, '{kind}' AS kind, {place} AS place, {least} AS least,
           unnest(regexp_extract_all(text, {pattern})) AS match,
           unnest(regexp_extract_all(text, {pattern}, {group})) AS counted,
           unnest(list_slice(string_split_regex(text, {pattern}), 1,
                             len(regexp_extract_all(text, {pattern})))) AS gap,
           unnest(range(len(regexp_extract_all(text, {pattern})))) AS k
    FROM d WHERE regexp_matches(text, {pattern})
"""
_LETTERS = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" for c in name)
    for name in ("password", "passwd", "secret", "token", "api_key")
)
_RULES = (
    ("assign", "(" + _LETTERS + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)
_SECRETS = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ("
    + " UNION ALL ".join(
        _PIECES.format(kind=k, place=i, pattern=f"'{p}'", group=g, least=n)
        for i, (k, p, g, n) in enumerate(_RULES)
    )
    + """), placed AS (
    SELECT *, length(gap) + coalesce(sum(length(gap) + length(match)) OVER (
        PARTITION BY doc_id, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS pos FROM m
), kept AS (
    SELECT *, kind || ':' || pos::BIGINT || ':' || (pos + length(match))::BIGINT AS span
    FROM placed WHERE length(counted) >= least
), byid AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b,
           count(*) FILTER (kind = 'hex') AS c, string_agg(span, ',' ORDER BY pos, place) AS spans
    FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN byid USING (doc_id)"""
)

#: CRC-32 of a short text of ASCII characters; ``crc`` is a table with one list ``t``.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""

_TRIE = f"""
WITH {_CRC_TABLE}, o AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                              sha256(coalesce(text, ''))) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), h AS (
    SELECT c, c - c % 5 AS base, n, {_CRC.format(text="c::VARCHAR")} % 9 AS h
    FROM (SELECT c, count(*) AS n FROM o GROUP BY c), crc
), plan AS (
    SELECT h.c, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS given FROM h LEFT JOIN h b ON b.c = h.base
), r AS (
    SELECT plan.c, p - h + given AS d, role, text FROM plan JOIN o USING (c) WHERE p > h
    UNION ALL SELECT plan.c, p, role, text FROM plan JOIN o ON o.c = plan.base WHERE p <= given
), prefix AS (
    SELECT c, d, strlen(text) AS bytes,
           list({{'role': role, 'text': text}}) OVER (PARTITION BY c ORDER BY d) AS path FROM r
    UNION ALL SELECT c, 0, 0, [] FROM plan
), m AS (
    SELECT c, d, bytes, min(c) OVER (PARTITION BY d, path) AS node, max(d) OVER (PARTITION BY c) = d AS last FROM prefix
), nodes AS (
    SELECT node, d, count(*) AS n_convs, max(bytes) AS bytes,
           coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends
    FROM m GROUP BY node, d
), up AS (
    SELECT nodes.*, m.node AS parent FROM nodes LEFT JOIN m ON m.c = nodes.node AND m.d = nodes.d - 1
), kids AS (SELECT parent, d - 1 AS d, count(*) AS k FROM up WHERE d > 0 GROUP BY ALL),
weights AS (
    SELECT up.*, coalesce(k, 0) AS k FROM up LEFT JOIN kids ON kids.parent = up.node AND kids.d = up.d
), totals AS (
    SELECT m.node, m.d, sum(w.k = 0) AS leaves, sum((w.n_convs - 1) * w.bytes) AS saved
    FROM weights w JOIN m ON m.c = w.node AND m.d <= w.d GROUP BY m.node, m.d
)
SELECT node AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n_convs, k AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM weights JOIN totals USING (node, d)"""


def _repair() -> str:
    """Dynamic programme from the last row to the first, then a walk forwards along its choices."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    own, letters = [], []
    for s in range(4):
        kept = " ".join(f"WHEN '{c}' THEN s.short + w{to}" for c, to in {**keeps[s], "": s}.items())
        own.append(f"CASE WHEN stays THEN CASE s.initial {kept} END END AS k{s}")
        own.append(f"least(3 + w{s}, k{s}, CASE WHEN stays THEN 2 + s.short + w{after[s]} END) AS a{s}")
        letters.append(
            f"CASE WHEN v{s} = 3 + w{s} THEN 'D' WHEN v{s} = 2 + v{after[s]} THEN 'I' WHEN v{s} = k{s} THEN 'K' ELSE 'R' END AS e{s}"
        )
    moves = " ".join(f"WHEN {s} THEN e{s}" for s in range(4))
    onward = " ".join(
        f"WHEN state = {s} AND e = 'K' AND initial = '{c}' THEN {to}" for s in keeps for c, to in keeps[s].items()
    )
    blank = r"[^\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE {_CRC_TABLE}, given AS (
    SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_CRC.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
    FROM conversations, crc
), damaged AS (
    SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM given
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), seen AS (
    SELECT *, left(role, 1) AS initial, CASE
        WHEN NOT regexp_matches(text, '{blank}') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before
    FROM placed
), n AS (
    SELECT c, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id AS c FROM conversations) LEFT JOIN seen USING (c) GROUP BY c
), back AS (
    SELECT c, n + 1 AS i, 0::BIGINT AS w0, 4::BIGINT AS w1, 2::BIGINT AS w2, 0::BIGINT AS w3,
           '' AS e0, 'I' AS e1, 'I' AS e2, '' AS e3, '' AS initial, '' AS role, '' AS text, 0::BIGINT AS short FROM n
    UNION ALL
    SELECT c, i, v0, v1, v2, v3, {", ".join(letters)}, initial, role, text, short FROM (
        SELECT *, least(a0, 2 + v2) AS v0, least(a1, 2 + v2) AS v1 FROM (
            SELECT *, least(a2, 2 + a3) AS v2, least(a3, 2 + a2) AS v3 FROM (
                SELECT b.c, s.i, w0, w1, w2, w3, s.initial, s.role, s.text, s.short, {", ".join(own)}
                FROM back b JOIN (
                    SELECT *, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS stays,
                           (coalesce(fault, '') = 'truncated')::BIGINT AS short FROM seen
                ) s ON s.c = b.c AND s.i = b.i - 1)))
), walk AS (
    SELECT c, 1::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM n
    UNION ALL
    SELECT c, i + (e <> 'I')::INT, CASE WHEN e = 'D' OR e = 'K' AND initial = '' THEN state {onward}
               WHEN state = 2 THEN 3 ELSE 2 END,
           cost + CASE e WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'K' THEN short ELSE 2 + short END, audit || e,
           CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
               ELSE list_append(lines, CASE state WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END) END
    FROM (SELECT w.*, b.initial, b.role, b.text, b.short, CASE state {moves} END AS e
          FROM walk w JOIN back b ON b.c = w.c AND b.i = w.i) WHERE e <> ''
), ended AS (
    SELECT walk.* FROM walk JOIN n USING (c) WHERE walk.i = n.n + 1 AND state IN (0, 3)
)
SELECT c AS conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
       sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM n JOIN ended USING (c)"""


_ITEM_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_LEAKS = f"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS rid, {_ITEM_WORDS} AS w FROM documents
), b AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(10, len(w)) AS n
    FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS run
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), looked AS (
    SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS run
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT rid, i, n, item FROM looked JOIN windows USING (n, run)),
covered AS (
    SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM hits) GROUP BY rid
), named AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""

ORACLES = {
    "op4_secret_scans": _SECRETS,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_prefix_trie": _TRIE,
    "op12_structure_repair": _repair(),
    "op13_decontamination": _LEAKS,
}
