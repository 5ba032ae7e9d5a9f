"""DuckDB SQL for the operators that SQL can express. It follows the contracts, not the operators' methods, where the two differ."""

from __future__ import annotations

from quarry.llm import licenses, mixing, secrets


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (SELECT doc_id, i, b[i:i+49] AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS i FROM d)),
covered AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM strings) WHERE first < doc_id),
runs AS (SELECT doc_id, i, sum(CASE WHEN i > before + 50 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
         FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM covered)),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 49 AS hi FROM runs GROUP BY doc_id, run),
pieces AS (SELECT doc_id, lo, hex(b[coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1:lo - 1]) AS kept, hi FROM spans JOIN d USING (doc_id)),
cut AS (SELECT doc_id, string_agg(kept, '' ORDER BY lo) AS kept, max(hi) AS last, sum(hi - lo + 1) AS removed, count(*) AS n_spans FROM (SELECT doc_id, pieces.lo, pieces.hi, kept FROM pieces) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN last IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(b[last + 1:n]))) END AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def op3(n_shards: int = 24, seed: str = "shard") -> str:
    """CRC-32 by its table, one byte after the other; ranks by plain windows."""
    return f"""
    WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
    crcs AS (SELECT list(v ORDER BY i) AS step FROM bits WHERE k = 8),
    bytes AS (SELECT *, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
    keyed AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum, md5('{seed}:' || doc_id) AS key, strlen(coalesce(text, '')) + 8 AS size,
      xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 8, step[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32 FROM bytes, crcs),
    placed AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id) - 1) / (2 * count(*) OVER (PARTITION BY stratum)) AS fraction FROM keyed),
    lined AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, key, doc_id) - 1 AS pos, count(*) OVER () AS n FROM placed)
    SELECT doc_id, source, size, text_crc32, 'rows' AS law, CAST(pos * {n_shards} // n AS INTEGER) AS shard,
      pos - (pos * {n_shards} // n * n + {n_shards - 1}) // {n_shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM lined
    """


def op5() -> str:
    kinds = [("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX), ("entropy", secrets.CANDIDATE)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS ord, '{k}' AS kind, regexp_extract_all(text, {quoted(p)}) AS m, string_split_regex(text, {quoted(p)}) AS g FROM d WHERE regexp_matches(text, {quoted(p)})" for i, (k, p) in enumerate(kinds)
    )
    allowed = f"NOT regexp_matches(p, '[0-9]|[A-Za-z][A-Z]') OR regexp_full_match(p, '[A-Z]+') OR NOT regexp_matches(p, '[A-Za-z]') OR regexp_matches(p, {quoted(secrets.PLACEHOLDER)})"
    w = secrets.WINDOW
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    matched AS ({found}),
    each AS (SELECT doc_id, ord, kind, unnest(m) AS found, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS j FROM matched),
    placed AS (SELECT *, CAST(sum(length(gap)) OVER o + coalesce(sum(length(found)) OVER (PARTITION BY doc_id, ord ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
               FROM each WINDOW o AS (PARTITION BY doc_id, ord ORDER BY j)),
    judged AS (SELECT doc_id, ord, kind, start, start + length(found) AS stop FROM placed WHERE
      CASE kind WHEN 'assign' THEN length(regexp_extract(found, {quoted("^" + secrets.ASSIGN + "$")}, 2)) >= 12
        WHEN 'entropy' THEN len(list_filter(string_split_regex(found, '=+'), lambda p: length(p) >= {w} AND NOT ({allowed})
          AND list_max(list_transform(range(1, length(p) - {w - 2}), lambda i: list_aggregate(string_split(substr(p, i, {w}), ''), 'entropy')))
              >= CASE WHEN regexp_full_match(p, '[0-9a-f]+|[0-9A-F]+') THEN {secrets.THRESHOLDS["hex"]} ELSE {secrets.THRESHOLDS["base64"]} END)) > 0
        ELSE TRUE END),
    told AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3), '') AS base,
        count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex, count(*) FILTER (ord = 3) AS n_entropy FROM judged GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (doc_id)
    """


def op6() -> str:
    k = licenses.K
    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(licenses.TEMPLATES))
    lead = ", ".join(f"lead(w, {i}) OVER o AS w{i}" for i in range(1, k))
    same = " AND ".join(f"g.w{i} = t.w{i}" for i in range(1, k))
    word = quoted(licenses.WORD)
    base = " UNION ALL ".join(
        f"SELECT doc_id, i, {quoted(label)} AS label FROM grams WHERE {' AND '.join(f'{c} = {quoted(w)}' for c, w in zip(('w', 'w1', 'w2'), phrase.split()))}" for phrase, label in licenses.PHRASES.items()
    )
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {word}) AS words FROM documents),
    grams AS (SELECT doc_id, i, w, {lead} FROM (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    texts(template, label, text) AS (VALUES {templates}),
    tw AS (SELECT template, label, regexp_extract_all(lower(text), {word}) AS words FROM texts),
    marks AS (SELECT template, label, len_ - {k - 1} AS size, i AS tpos, w, {lead} FROM (SELECT template, label, len(words) AS len_, unnest(words) AS w, unnest(range(len(words))) AS i FROM tw)
              WINDOW o AS (PARTITION BY template ORDER BY i)),
    votes AS (SELECT g.doc_id, t.template, t.label, t.size, g.i AS pos, t.tpos, g.i - t.tpos AS diagonal FROM grams g JOIN marks t ON g.w = t.w AND {same}),
    bands AS (SELECT a.doc_id, a.template, a.label, count(DISTINCT v.tpos) / a.size AS coverage
              FROM (SELECT DISTINCT doc_id, template, label, size, diagonal FROM votes) a JOIN votes v ON a.doc_id = v.doc_id AND a.template = v.template
                AND v.diagonal - a.diagonal BETWEEN 0 AND greatest(1, floor({licenses.STRETCH - 1} * (a.size + {k - 1})))
              GROUP BY a.doc_id, a.template, a.label, a.size, a.diagonal),
    spans AS (SELECT * FROM bands WHERE coverage >= {licenses.COVER}),
    base AS ({base}),
    b AS (SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS labels FROM base GROUP BY doc_id),
    s AS (SELECT doc_id, max(coverage) AS best, list(DISTINCT label) AS labels FROM spans GROUP BY doc_id)
    SELECT d.doc_id, len(words) AS n_words, coalesce(b.n, 0) AS n_base, first AS first_word, last AS last_word,
      coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(s.labels, [])))), ',') AS labels,
      greatest(coalesce(best, 0.0), CASE WHEN b.n > 0 THEN {licenses.PHRASE_SCORE} ELSE 0.0 END) AS score
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)
    """


def op8(max_bits: int = 3) -> str:
    """XXH64 in 128-bit arithmetic over byte lists, majority bits by sums, classes by a recursive closure over distinct fingerprints."""
    m = "18446744073709551616"
    p1, p2, p3, p4, p5, seed = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 42
    u = lambda x: f"CAST({x} AS UHUGEINT)"
    mul = lambda a, p: f"(({a}) * {u(p)} % {u(m)})"
    rotl = lambda x, r: f"(({x}) * {u(1 << r)} % {u(m)} + ({x}) // {u(1 << (64 - r))})"
    step = lambda acc, lane: mul(rotl(f"({acc} + {mul(lane, p2)}) % {u(m)}", 31), p1)
    lane = lambda at, n: "(" + " + ".join(f"b[{at} + {j}] * {u(1 << (8 * (j - 1)))}" for j in range(1, n + 1)) + ")"
    shift = lambda x, r: f"xor({x}, ({x}) // {u(1 << r)})"

    def fold(first: str, items: str, body: str) -> str:
        return f"list_reduce(list_prepend({first}, {items}), lambda a, x: {body})"

    def stripe(i: int, start: int) -> str:
        return fold(u(start % (1 << 64)), f"list_transform(range(0, n // 32 * 32, 32), lambda k: {lane(f'k + {8 * i}', 8)})", step("a", "x"))

    joined = "(" + " + ".join(rotl(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18))) + f") % {u(m)}"
    for i in range(4):
        joined = f"({mul(f'xor({joined}, {step(u(0), f"v{i}")})', p1)} + {u(p4)}) % {u(m)}"
    rounds = [
        ("h0", f"(CASE WHEN n >= 32 THEN {joined} ELSE {u(seed + p5)} END + {u('n')}) % {u(m)}"),
        ("h1", fold("h0", f"list_transform(range(n // 32 * 32, n // 8 * 8, 8), lambda k: {lane('k', 8)})", f"({mul(rotl(f'xor(a, {step(u(0), "x")})', 27), p1)} + {u(p4)}) % {u(m)}")),
        ("h2", f"CASE WHEN n % 8 >= 4 THEN ({mul(rotl(f'xor(h1, {mul(lane("n // 8 * 8", 4), p1)})', 23), p2)} + {u(p3)}) % {u(m)} ELSE h1 END"),
        ("h3", fold("h2", "b[n // 4 * 4 + 1:]", mul(rotl(f"xor(a, {mul('x', p5)})", 11), p1))),
        ("h4", mul(shift("h3", 33), p2)),
        ("h5", mul(shift("h4", 29), p3)),
        ("h", shift("h5", 32)),
    ]
    ctes, last = "", "stripes"
    for name, body in rounds:
        ctes += f", r_{name} AS (SELECT *, {body} AS {name} FROM {last})"
        last = f"r_{name}"
    bits = " + ".join(f"CASE WHEN 2 * sum(k * CAST(h // {u(1 << i)} % 2 AS BIGINT)) > sum(k) THEN {u(1 << i)} ELSE 0 END" for i in range(64))
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM d),
    c AS (SELECT doc_id, s, count(*) AS k FROM s GROUP BY ALL),
    texts AS (SELECT s, strlen(s) AS n, list_transform(string_split(regexp_replace(hex(encode(s)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: CAST(CAST('0x' || h AS BIGINT) AS UHUGEINT)) AS b FROM (SELECT DISTINCT s FROM c)),
    stripes AS (SELECT *, {stripe(0, seed + p1 + p2)} AS v0, {stripe(1, seed + p2)} AS v1, {stripe(2, seed)} AS v2, {stripe(3, seed - p1)} AS v3 FROM texts){ctes},
    made AS (SELECT doc_id, {bits} AS fp FROM c JOIN {last} USING (s) GROUP BY doc_id),
    prints AS (SELECT doc_id, coalesce(fp, 0) AS fp FROM d LEFT JOIN made USING (doc_id)),
    reps AS (SELECT fp, min(doc_id) AS rep FROM prints GROUP BY fp),
    links AS (SELECT a.fp AS x, b.fp AS y FROM reps a JOIN reps b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS HUGEINT)) <= {max_bits}),
    reach(x, y) AS (SELECT fp, fp FROM reps UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    classes AS (SELECT x AS fp, min(rep) AS component_id FROM reach JOIN reps ON y = fp GROUP BY x)
    SELECT doc_id, lpad(lower(hex(CAST(fp AS UBIGINT))), 16, '0') AS fingerprint, component_id FROM prints JOIN classes USING (fp)
    """


OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
OP9 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op10() -> str:
    """The mix's slots; the schedule of one period is built slot by slot in a recursive query."""
    parts = mixing.TARGETS
    period, rows = sum(parts.values()), ", ".join(f"({quoted(s)}, {n})" for s, n in parts.items())
    return f"""
    WITH RECURSIVE parts(stratum, n) AS (VALUES {rows}),
    named AS (SELECT array_agg(stratum ORDER BY stratum) AS names, array_agg(n ORDER BY stratum) AS ns FROM parts),
    sim(slot, done, pick) AS (
      SELECT -1, list_transform(ns, lambda x: 0), 0 FROM named
      UNION ALL
      SELECT slot + 1, list_transform(done, lambda x, i: CASE WHEN i = chosen THEN x + 1 ELSE x END), chosen
      FROM (SELECT slot, done, list_min(list_filter(list_transform(range(1, len(ns) + 1), lambda i:
              CASE WHEN done[i] < ns[i] AND done[i] * {period} // ns[i] <= slot + 1
                   THEN ((done[i] + 1) * {period} + ns[i] - 1) // ns[i] * 1000 + i END), lambda v: v IS NOT NULL)) % 1000 AS chosen
            FROM sim, named WHERE slot + 1 < {period})),
    plan AS (SELECT names[pick] AS stratum, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS turn FROM sim, named WHERE pick > 0),
    ranked AS (SELECT doc_id, source, CASE WHEN source IN (SELECT stratum FROM parts WHERE stratum <> 'rest') THEN source ELSE 'rest' END AS stratum FROM documents),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('mix:' || doc_id)) - 1 AS r FROM ranked)
    SELECT doc_id, source, stratum, r // {mixing.BLOCK_ROWS} + 1 AS block, (r // {mixing.BLOCK_ROWS}) // n * {period} + p.slot AS slot, r % {mixing.BLOCK_ROWS} AS in_block
    FROM numbered JOIN parts USING (stratum) JOIN plan p USING (stratum)
    WHERE p.turn = (r // {mixing.BLOCK_ROWS}) % n
    """


def all_sql() -> dict[str, str]:
    """By the queries' names."""
    return {"op2_suffix_dedup": OP2, "op3_sharding": op3(), "op5_secrets": op5(), "op6_licenses": op6(), "op7_top_k": OP7, "op8_simhash": op8(), "op9_exact_dedup": OP9, "op10_mixing": op10()}
