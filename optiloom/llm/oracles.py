"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Fixed values, written out here and not taken from the operators: the contract's kinds of secrets, then the two that the method adds.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36),
)
SYMBOLS = "#*$%&|<>"
BOILERPLATE = ("accept all cookies", "all rights reserved", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "terms of use", "terms of service", "use of cookies")
_WORD = r"[^\x20\x09-\x0D]+"


def _op2() -> str:
    window = "concat_ws(' ', w, " + ", ".join(f"lead(w, {k}) OVER o" for k in range(1, 13)) + ")"
    words = f"regexp_extract_all(text, '{_WORD}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, unnest({words}) AS w, generate_subscripts({words}, 1) AS i FROM d),
v AS (SELECT r, doc_id, i, {window} AS k, lead(w, 12) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS least FROM v WHERE whole) WHERE least < doc_id),
g AS (SELECT DISTINCT r, i + j AS i FROM c, (SELECT unnest(range(0, 13)) AS j)),
a AS (SELECT w.r, count(*) AS n, count(g.i) AS gone, string_agg(w, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS kept FROM w LEFT JOIN g ON g.r = w.r AND g.i = w.i GROUP BY w.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (r)"""


def _op3() -> str:
    def matches(i: int, pattern: str, group: int) -> str:
        q = pattern.replace("'", "''")
        return f"list_transform(string_split_regex(t, '{q}'), lambda x: length(x)) AS g{i}, list_transform(regexp_extract_all(t, '{q}', 0), lambda x: length(x)) AS s{i}, list_transform(regexp_extract_all(t, '{q}', {group}), lambda x: length(x)) AS t{i}"

    def spans(i: int, kind: str, least: int) -> str:
        return f"SELECT r, g{i}[k] + coalesce(list_sum(g{i}[1:k-1]), 0) + coalesce(list_sum(s{i}[1:k-1]), 0) AS a, {i} AS rk, '{kind}' AS kind, s{i}[k] AS n FROM (SELECT *, unnest(range(1, len(s{i}) + 1)) AS k FROM m) WHERE t{i}[k] >= {least}"

    parts = ", ".join(matches(i, p, g) for i, (_, p, g, _) in enumerate(RULES))
    union = " UNION ALL ".join(spans(i, kind, least) for i, (kind, _, _, least) in enumerate(RULES))
    joined = "coalesce(string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, rk){}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind, *_ in RULES[:3])
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, {parts} FROM d), f AS ({union})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256({joined.format(" FILTER (WHERE rk < 3)")}) AS base_sha256, {joined.format("")} AS spans
FROM d LEFT JOIN f USING (r) GROUP BY r"""


def _op6() -> str:
    words = f"regexp_extract_all({{}}, '{_WORD}')"
    window = "concat_ws(' ', w, " + ", ".join(f"lead(w, {k}) OVER o" for k in range(1, 5)) + ")"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest({words.format("t")}) AS w, generate_subscripts({words.format("t")}, 1) AS i FROM d),
v AS (SELECT r, i, {window} AS k, lead(w, 4) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM v WHERE whole) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM c, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM w GROUP BY r),
li AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
lf AS (SELECT l, r, len({words.format("l")}) AS n,
  length(l) - length(replace(l, '|', '')) > 0.03 * length(l) OR length(l) - length(replace(l, '!', '')) > 0.05 * length(l)
  OR length(l) - length(translate(l, '{SYMBOLS}', '')) > 0.1 * length(l) OR regexp_matches(lower(l), '{"|".join(BOILERPLATE)}') AS bad FROM li),
la AS (SELECT r, sum(n) FILTER (WHERE bad) AS lost, count(*) FILTER (WHERE n > 0) - count(DISTINCT l) FILTER (WHERE n > 0) AS dup FROM lf GROUP BY r),
s AS (SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost FROM d LEFT JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN la USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT lost > 0.3 * n_words AS kept FROM s"""


def _op8() -> str:
    words = r"regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii"
    window = "concat_ws(' ', w, " + ", ".join(f"lead(w, {k}) OVER o" for k in range(1, 10)) + ")"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {lower} FROM documents),
b AS (SELECT row_number() OVER () AS r, coalesce(item_id::VARCHAR, '') AS item, {lower} FROM benchmark),
dw AS (SELECT r, unnest({words}) AS w, generate_subscripts({words}, 1) AS i FROM d),
bw AS (SELECT r, item, unnest({words}) AS w, generate_subscripts({words}, 1) AS i, len({words}) AS n FROM b),
pat AS (SELECT DISTINCT item, least(n, 10) AS n, k FROM (SELECT r, item, i, n, {window} AS k FROM bw WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE i + least(n, 10) - 1 <= n),
short AS (SELECT DISTINCT n FROM pat),
dv AS (SELECT r, i, s.n, list_aggregate(list(w) OVER (PARTITION BY r, s.n ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)[1:s.n], 'string_agg', ' ') AS k FROM dw, short s),
h AS (SELECT DISTINCT r, i, n, item FROM dv JOIN pat USING (n, k)),
hw AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM h, (SELECT unnest(range(0, 10)) AS j) WHERE j < n GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM dw GROUP BY r)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)"""


def _op9() -> str:
    words = f"list_sort(list_distinct(regexp_extract_all(l, '{_WORD}')))"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
li AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
s AS (SELECT r, i, l, {words} AS k, row_number() OVER (ORDER BY doc_id NULLS FIRST, r, i) AS p FROM li),
w AS (SELECT p, k, len(k) AS n, min(p) OVER (PARTITION BY k) AS first FROM s WHERE len(k) > 0),
f AS (SELECT p, k, n FROM w WHERE p = first),
t AS (SELECT p, n, unnest(k) AS tok FROM f WHERE n > 3),
c AS (SELECT tok, count(*) AS c FROM t GROUP BY tok),
o AS (SELECT p, n, tok, row_number() OVER (PARTITION BY p ORDER BY c, tok) AS place FROM t JOIN c USING (tok)),
x AS (SELECT * FROM o WHERE place <= n - (4 * n + 4) // 5 + 1),
j AS (SELECT DISTINCT a.p AS p, b.p AS q FROM x a JOIN x b ON a.tok = b.tok AND a.p > b.p AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
near AS (SELECT DISTINCT j.p FROM j JOIN f a ON a.p = j.p JOIN f b ON b.p = j.q WHERE 9 * len(list_intersect(a.k, b.k)) >= 4 * (a.n + b.n)),
gone AS (SELECT p FROM w WHERE p <> first UNION SELECT p FROM near),
e AS (SELECT r, count(*) AS n, count(gone.p) AS g, string_agg(l, chr(10) ORDER BY i) FILTER (WHERE gone.p IS NULL) AS kept FROM s LEFT JOIN gone USING (p) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(g, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS text_sha256 FROM d LEFT JOIN e USING (r)"""


def _op11() -> str:
    return """WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n)) AS tab),
c AS (SELECT c, c - c % 100 AS b, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1]), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), tab),
k AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x FROM conversations),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS i, n, x FROM k),
r AS (SELECT c, 0 AS part, i, n, x FROM c JOIN o ON conv_id = b AND i <= h UNION ALL SELECT c, 1, i, n, x FROM c JOIN o ON conv_id = c AND i > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, n, x FROM r),
m AS (SELECT c, 0 AS d, []::VARCHAR[] AS p, 0 AS n FROM c UNION ALL SELECT c, d, list(x) OVER (PARTITION BY c ORDER BY d), n FROM s),
z AS (SELECT c, max(d) AS size FROM m GROUP BY c),
g AS (SELECT p, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saves, bool_and(d = size) AS leaf, string_agg(c, ',' ORDER BY c) FILTER (WHERE d = size) AS ends FROM m JOIN z USING (c) GROUP BY p),
u AS (SELECT DISTINCT a.p AS top, b.p FROM m AS a JOIN m AS b ON a.c = b.c AND b.d >= a.d),
t AS (SELECT top AS p, sum(leaf::INTEGER)::BIGINT AS n_leaves, sum(saves)::BIGINT AS saved_tokens FROM u JOIN g USING (p) GROUP BY top),
h AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1)
SELECT g.conv_id, g.d AS depth, CASE WHEN g.d > 0 THEN up.conv_id END AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN t USING (p) LEFT JOIN h USING (p) LEFT JOIN g AS up ON up.p = g.p[1:g.d - 1]"""


def _op12() -> str:
    steps = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))""",
        "c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h LIMIT 16))",
    ]
    for t in range(4):
        far = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{t} AS (SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.e) AS e, min(struct_pack(d := {far}, k := c.k)) AS m FROM v, c{t} AS c GROUP BY r)")
        if t < 3:
            steps.append(f"""s{t} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{t}) GROUP BY k, i),
n{t} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM s{t} GROUP BY k),
c{t + 1} AS (SELECT c.k, coalesce(n.e, c.e) AS e FROM c{t} AS c LEFT JOIN n{t} AS n USING (k))""")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, a.m.k::INTEGER AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.k))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a3 AS a JOIN c3 AS c ON c.k = a.m.k"""


SQL = {"op2_substring_dedup": _op2(), "op3_secret_scan": _op3(), "op6_quality_rules": _op6(), "op8_decontamination": _op8(), "op9_line_dedup": _op9(), "op11_conversation_trie": _op11(), "op12_centroid_clustering": _op12()}
