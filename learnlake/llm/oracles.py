"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SOLID = r"[^\x20\x09-\x0D]+"


def url_trust(rules: list, damping: float, rounds: int, excess: float) -> str:
    """Rules by length, then both ranks with the rounds unrolled."""
    table = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.text}')" for r in rules)
    steps = []
    for name, src, dst, share in (("t", "src", "dst", "allowed"), ("d", "dst", "src", "blocked")):
        steps.append(f"{name}f AS MATERIALIZED (SELECT e.{src} AS a, e.{dst} AS b, e.n / sum(e.n) OVER (PARTITION BY e.{src}) AS share FROM edges e)")
        steps.append(f"{name}0 AS MATERIALIZED (SELECT host, {1 - damping!r} * {share} AS score FROM seeds WHERE {share} > 0)")
        for k in range(rounds):
            steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT * FROM {name}0 UNION ALL SELECT b, {damping!r} * share * score FROM {name}f JOIN {name}{k} ON a = host) GROUP BY host)")
    host = lambda u: f"translate(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hrefs = """regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)"""
    return f"""WITH rules(verdict, host, path, rule) AS (VALUES {table}),
    p AS MATERIALIZED (SELECT page_id, html, {host("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*(/?[^?#]*)', 1) AS path FROM pages),
    judged AS MATERIALIZED (SELECT p.*, (SELECT max_by({{'rule': r.rule, 'verdict': r.verdict}}, length(r.rule)) FROM rules r WHERE p.host <> '' AND ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.path)) AS fit FROM p),
    seeds AS MATERIALIZED (SELECT host, avg(CASE WHEN fit.verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN fit.verdict = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM judged WHERE host <> '' GROUP BY host),
    links AS (SELECT src, dst FROM (SELECT host AS src, unnest(list_distinct(list_transform({hrefs}, lambda x: {host("CASE WHEN starts_with(x, '//') THEN 'x:' || x ELSE x END")}))) AS dst FROM p) WHERE src <> '' AND dst <> '' AND src <> dst),
    edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM links GROUP BY ALL), {", ".join(steps)}
    SELECT j.page_id, j.host, j.path, j.fit.rule AS rule, coalesce(j.fit.verdict, CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0) > {excess * (1 - damping)!r} THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged j LEFT JOIN t{rounds} t ON t.host = j.host LEFT JOIN d{rounds} d ON d.host = j.host"""


def lm_scoring(backoff: float, unseen: float) -> str:
    """Bigram scores with a document's own counts taken off."""
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, w, i, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SOLID}') AS x FROM documents))),
    n AS (SELECT count(*) AS n FROM w), nd AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
    u AS (SELECT w, count(*) AS c FROM w GROUP BY 1), ud AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY ALL),
    b AS (SELECT v, w, count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY ALL), bd AS (SELECT doc_id, v, w, count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY ALL),
    s AS (SELECT w.doc_id, CASE WHEN w.v IS NOT NULL AND b.c - bd.c > 0 THEN ln((b.c - bd.c) / CAST(uv.c - uvd.c AS DOUBLE))
        ELSE (CASE WHEN w.v IS NULL THEN 0 ELSE ln({backoff}) END) + ln(greatest(u.c - ud.c, {unseen}) / CAST(greatest((SELECT n FROM n) - nd.n, 1) AS DOUBLE)) END AS x
        FROM w JOIN nd USING (doc_id) JOIN u ON u.w = w.w JOIN ud ON ud.doc_id = w.doc_id AND ud.w = w.w LEFT JOIN b ON b.v = w.v AND b.w = w.w LEFT JOIN bd ON bd.doc_id = w.doc_id AND bd.v = w.v AND bd.w = w.w
        LEFT JOIN u uv ON uv.w = w.v LEFT JOIN ud uvd ON uvd.doc_id = w.doc_id AND uvd.w = w.v)
    SELECT d.doc_id, coalesce(g.n, 0) AS n_words, round(coalesce(g.x, 0), 4) AS log_score, round(g.x / g.n, 6) AS mean_log_score FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(x) AS x FROM s GROUP BY 1) g USING (doc_id)"""


def decontamination(window: int) -> str:
    """Windows of items met in documents, window length by window length."""
    return f"""WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS x FROM benchmark),
    win AS (SELECT DISTINCT item_id, k, array_to_string(x[s:s + k - 1], ' ') AS g FROM (SELECT item_id, x, least(len(x), {window}) AS k, unnest(generate_series(1, greatest(len(x) - {window} + 1, 1))) AS s FROM i WHERE len(x) > 0)),
    d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS x FROM documents),
    dw AS (SELECT doc_id, k, s, array_to_string(x[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, x, k, unnest(generate_series(1, len(x) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(x) >= k)),
    m AS MATERIALIZED (SELECT dw.doc_id, dw.s, dw.k, win.item_id FROM dw JOIN win ON win.k = dw.k AND win.g = dw.g),
    h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS pos FROM m) GROUP BY 1),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY 1)
    SELECT d.doc_id, CAST(coalesce(len(d.x), 0) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def ngram_jaccard(size: int, percent: int) -> str:
    """Sets, links by shared shingles, and components by spreading the smallest doc_id."""
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_SOLID}'), []) AS x FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(x[i:i + {size - 1}], ' ') AS g FROM (SELECT doc_id, x, unnest(generate_series(1, greatest(len(x) - {size - 1}, 1))) AS i FROM w WHERE len(x) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= {percent} * (na.n + nb.n - shared)),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) c USING (doc_id)"""


#: CRC-32 of a text: its 256 entries come from eight steps of the reversed polynomial 0xEDB88320.
_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def _crc32(text: str, table: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; table is a column with the entries."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, {table}[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295)"


def merkle_manifest(levels: int, top_levels: int) -> str:
    """The trees level by level, unrolled: groups of up to 16 ** levels leaves, 16 ** top_levels groups."""
    field = lambda v: f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')"
    whole = lambda text: "sha256(" + " || ".join(field(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    steps, paths = [], []
    for name, depth in (("g", levels), ("r", top_levels)):
        for k in range(depth):
            steps.append(f"""{name}w{k} AS MATERIALIZED (SELECT tree, i, h, m, coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k})""")
            steps.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 16 AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, CAST(ceil(any_value(m) / 16) AS BIGINT) AS m FROM {name}{k} GROUP BY tree, i // 16)""")
            paths.append((f"{name}w{k}", name, k))
        if name == "g":
            steps.append(f"r0 AS MATERIALIZED (SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS m FROM g{levels})")
    joins = " ".join(f"JOIN {t} AS {t} ON {t}.tree = " + (f"l.tree AND {t}.i = l.i // {16**k}" if n == "g" else f"0 AND {t}.i = l.tree // {16**k}") for t, n, k in paths)
    proof = " || ".join(f"CASE WHEN {t}.m > 1 THEN {t}.a || {t}.b ELSE '' END" for t, _, _ in paths)
    folds, now = [], "f"
    for t, _, _ in paths:
        folds.append(f"{now}_{t} AS (SELECT * EXCLUDE (f), CASE WHEN {t}_m > 1 THEN sha256({t}_a || f || {t}_b) ELSE f END AS f FROM {now})")
        now = f"{now}_{t}"
    columns = ", ".join(f"{t}.m AS {t}_m, {t}.a AS {t}_a, {t}.b AS {t}_b" for t, _, _ in paths)
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH crc AS MATERIALIZED {_CRC_TABLE},
    d AS MATERIALIZED (SELECT doc_id, source, {whole("text")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)", "crc.t")} % 5 = 0 THEN {whole(lowered)} ELSE {whole("text")} END AS f FROM documents, crc),
    l AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
    g0 AS MATERIALIZED (SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS m FROM l), {", ".join(steps)},
    f AS (SELECT l.doc_id, l.leaf, g.h AS subroot, r.h AS root, sha256({proof}) AS proof_sha256, l.f, {columns} FROM l JOIN g{levels} g ON g.tree = l.tree CROSS JOIN r{top_levels} r {joins}), {", ".join(folds)}
    SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM {now}"""


def spelling_variants(loss: int, length: int, least: int, ratio: int) -> str:
    """Words as read, near words by their texts with one character left out, and chains of forms."""
    return f"""WITH RECURSIVE crc AS MATERIALIZED {_CRC_TABLE},
    r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
    h AS MATERIALIZED (SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run", "crc.t")} AS h FROM r, crc WHERE length(run) >= {length}),
    w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {loss} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= {length} GROUP BY word HAVING sum(n) >= {least}),
    d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
    p AS MATERIALIZED (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.v = b.v AND a.word <> b.word UNION SELECT d.word, w.word FROM d JOIN w ON w.word = d.v UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.v),
    b AS (SELECT p.a AS word, p.b AS form, w.n AS form_n, count(*) OVER (PARTITION BY p.a) AS n_near, row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, p.b) AS k FROM p JOIN w ON w.word = p.b),
    f AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= {ratio} * w.n THEN b.form END AS form, CASE WHEN b.form_n >= {ratio} * w.n THEN b.form_n END AS form_n FROM w LEFT JOIN b ON b.word = w.word AND b.k = 1),
    c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.root WHERE e.form IS NULL"""
