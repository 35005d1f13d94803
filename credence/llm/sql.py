"""DuckDB statements for the results of the queries that SQL can express."""

WORD = r"'[^\x20\x09-\x0D]+'"

SEED_EXTEND = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h
        FROM d, unnest(range(1, len(w) - 48)) AS t(s)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
hit AS (SELECT win.doc_id, win.s FROM win JOIN low USING (h) WHERE low.low < win.doc_id),
gone AS (SELECT DISTINCT doc_id, s + i AS pos FROM hit, unnest(range(0, 50)) AS t(i)),
pos AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
word AS (SELECT d.doc_id, i AS pos, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.pos) AS txt
         FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.pos = word.pos
         WHERE gone.pos IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(pos.gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

BWT_MERGE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
win AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 100)) AS h FROM n, unnest(range(0, n - 49)) AS t(s)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
hit AS (SELECT win.doc_id, win.s, row_number() OVER (PARTITION BY win.doc_id ORDER BY win.s) AS k
        FROM win JOIN low USING (h) WHERE low.low < win.doc_id),
brk AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM brk),
span AS (SELECT doc_id, g, min(s) AS a, max(s) + 50 AS b FROM run GROUP BY doc_id, g),
gap AS (SELECT n.doc_id, coalesce(lag(span.b) OVER w, 0) AS a, span.a AS b FROM span JOIN n USING (doc_id)
        WINDOW w AS (PARTITION BY span.doc_id ORDER BY span.a)
        UNION ALL
        SELECT n.doc_id, coalesce(max(span.b), 0), any_value(n.n) FROM n LEFT JOIN span ON span.doc_id = n.doc_id GROUP BY n.doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(n.x, 2 * gap.a + 1, 2 * (gap.b - gap.a)), '' ORDER BY gap.a) AS x
         FROM gap JOIN n ON n.doc_id = gap.doc_id GROUP BY gap.doc_id),
cnt AS (SELECT doc_id, count(*) AS c, sum(b - a) AS r FROM span GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(cnt.r, 0)::BIGINT AS n_removed, coalesce(cnt.c, 0)::BIGINT AS n_spans,
       sha256(unhex(kept.x)) AS kept_sha256
FROM n LEFT JOIN cnt ON cnt.doc_id = n.doc_id LEFT JOIN kept ON kept.doc_id = n.doc_id
"""

SETSKETCH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM d),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sh),
one AS (SELECT doc_id, hash(unnest(s)) AS g FROM sh),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS r FROM sym UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.r),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c, n.doc_id) AS component_id, n.doc_id = coalesce(c, n.doc_id) AS kept
FROM n LEFT JOIN comp ON comp.doc_id = n.doc_id
"""


def _quality() -> str:
    from credence.llm.quality import CLASS_LIMIT, WORD_GUARD, WORD_LIMIT, WORD_LIST

    words = "[" + ", ".join(f"'{w}'" for w in WORD_LIST) + "]"

    def distance(p: str, q: str) -> str:
        part = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
        p_, q_ = f"{p}[i]", f"{q}[i]"
        return f"sqrt(greatest(list_sum([({part.format(a=p_, b=q_)} + {part.format(a=q_, b=p_)}) / 2 FOR i IN range(1, len({p}) + 1)]), 0))"

    def mean(x: str, n: int) -> str:
        return "[" + ", ".join(f"avg({x}[{i}])" for i in range(1, n + 1)) + "]"

    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS x(i)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, unnest([0, 1, 2]) AS x(j) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, d.lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(t) AS chars,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS up, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS dg,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^.,;:!?''"()-]+', '', 'g')) AS mk,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             [len(list_filter(w, lambda x: lower(x) = c)) FOR c IN {words}] AS common
      FROM d JOIN ln ON ln.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             [up, dg, n_symbols, mk, chars - word_chars, word_chars - up - dg - n_symbols - mk] AS c6,
             list_append(common, n_words - list_sum(common)) AS cw FROM m),
s AS (SELECT *, [x / greatest(list_sum(c6), 1) FOR x IN c6] AS c, [x / greatest(list_sum(cw), 1) FOR x IN cw] AS v FROM b),
r AS (SELECT lang, {mean('c', 6)} AS rc, {mean('v', len(WORD_LIST) + 1)} AS rv FROM s WHERE NOT base_failed GROUP BY lang),
j AS (SELECT s.*, {distance('c', 'rc')} AS dc, {distance('v', 'rv')} AS dv FROM s LEFT JOIN r ON s.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(dc > {CLASS_LIMIT} OR (n_words >= {WORD_GUARD} AND dv > {WORD_LIMIT}), false) AS kept
FROM j
"""


QUALITY = _quality()

RANGE_JOIN = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, rhost, rpath, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                          ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fit AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
        FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM p LEFT JOIN fit ON fit.page_id = p.page_id
"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text; needs the column ``crc_table`` in scope."""
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)), "
            f"lambda crc, b: xor(crc >> 8, crc_table[(xor(crc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)")


TRIE = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n)) AS crc_table),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS id, CAST(strlen(text) AS BIGINT) AS bytes FROM t),
o AS (SELECT conv_id, id, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS pos FROM i),
s AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
h AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS base FROM s, crc),
m AS (SELECT h.*, least(h.h, coalesce(b.n, 0)) AS taken FROM h LEFT JOIN s b ON b.conv_id = h.base),
cells AS (SELECT m.conv_id, o.pos + taken - h AS place, id, bytes FROM o JOIN m ON o.conv_id = m.conv_id WHERE pos >= h
          UNION ALL SELECT m.conv_id, o.pos, id, bytes FROM m JOIN o ON o.conv_id = m.base WHERE o.pos < taken),
paths AS MATERIALIZED (
  SELECT conv_id, place + 1 AS d, md5(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY place)) AS k, bytes FROM cells
  UNION ALL SELECT conv_id, 0, '', 0 FROM m),
nodes AS MATERIALIZED (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM paths GROUP BY d, k),
up AS (SELECT n.d, n.k, p.k AS above FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
below AS (SELECT d - 1 AS d, above AS k, count(*) AS n_children FROM up GROUP BY d, above),
own AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN below b ON b.d = n.d AND b.k = n.k),
subtree AS (SELECT a.d, a.k, CAST(sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved_tokens
            FROM own n JOIN paths a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.k),
ends AS (SELECT p.d, p.k, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends_sha256
         FROM paths p JOIN (SELECT conv_id, max(d) AS d FROM paths GROUP BY conv_id) f ON f.conv_id = p.conv_id AND f.d = p.d GROUP BY p.d, p.k)
SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM own n JOIN subtree s ON s.d = n.d AND s.k = n.k LEFT JOIN ends e ON e.d = n.d AND e.k = n.k
LEFT JOIN up u ON u.d = n.d AND u.k = n.k LEFT JOIN nodes a ON a.d = u.d - 1 AND a.k = u.above
"""


def _edit(entry: str, cost: str, letter: str) -> str:
    """An entry (nine digits of cost, then the audit; ``~`` is none and sorts last) after one more edit."""
    return f"CASE WHEN {entry} = '~' THEN '~' ELSE lpad(CAST(CAST(substr({entry}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({entry}, 10) || {letter} END"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _with_inserts(entries: str) -> str:
    """The entries of the four states (nothing, s, u, a) after any useful inserts."""
    user = "least(e[3], " + _edit("least(e[1], e[2], e[4])", "2", "'I'") + ")"
    return _bound(entries, "e", _bound(user, "u", f"[e[1], e[2], u, least(e[4], {_edit('u', '2', chr(39) + 'I' + chr(39))})]"))


def _row(entries: str, symbol: str) -> str:
    """The entries after one row: deleted, kept or reroled, then inserts."""
    extra, kind = f"CASE WHEN substr({symbol}, 2, 1) = 't' THEN 1 ELSE 0 END", f"substr({symbol}, 1, 1)"

    def named(role: str, before: str) -> str:
        return _edit(before, f"({extra} + CASE WHEN {kind} = '{role}' THEN 0 ELSE 2 END)", f"CASE WHEN {kind} = '{role}' THEN 'K' ELSE 'R' END")
    gone = [_edit(f"b[{i}]", "3", "'D'") for i in range(1, 5)]
    kept = [gone[0], f"least({gone[1]}, CASE WHEN {kind} = 's' THEN {_edit('b[1]', extra, chr(39) + 'K' + chr(39))} ELSE '~' END)",
            f"least({gone[2]}, {named('u', 'least(b[1], b[2], b[4])')})", f"least({gone[3]}, {named('a', 'b[3]')})"]
    return _bound(entries, "b", _with_inserts(f"CASE WHEN {symbol} = 'x' THEN [{', '.join(gone)}] ELSE [{', '.join(kept)}] END"))


REPAIR = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n)) AS crc_table),
z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
d AS MATERIALIZED (SELECT conv_id, turn, role, text, substr(sha256(length(role) || ':' || role || text), 1, 32) AS tie, {crc32_sql("name")} % 20 AS deal FROM z, crc),
r AS (SELECT conv_id, turn, tie, unnest(CASE WHEN deal = 3 THEN [0, 1] ELSE [0] END) AS again, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN deal = 1 THEN '' WHEN deal = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM d WHERE deal <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, again) AS pos FROM r),
f AS (SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS initial,
             CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '.' END AS fault FROM p),
c AS (SELECT conv_id, count(*) AS n, list(CASE WHEN fault IN ('b', 'd') THEN 'x' ELSE initial || fault END ORDER BY pos) AS symbols,
             list(initial ORDER BY pos) AS initials, list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts,
             coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count_if(fault = 'b') AS BIGINT) AS blank, CAST(count_if(fault = 'd') AS BIGINT) AS duplicate, CAST(count_if(fault = 't') AS BIGINT) AS truncated
      FROM f GROUP BY conv_id),
best AS MATERIALIZED (SELECT *, list_transform([string_split(list_reduce(symbols, lambda a, x: array_to_string({_row("string_split(a, '|')", "x")}, '|'),
                        array_to_string({_with_inserts("['000000000', '~', '~', '~']")}, '|')), '|')], lambda e: least(e[1], e[4]))[1] AS entry FROM c),
audits AS (SELECT *, CAST(substr(entry, 1, 9) AS BIGINT) AS cost, substr(entry, 10) AS audit, length(substr(entry, 10)) - length(ltrim(substr(entry, 10), 'D')) + 1 AS opening FROM best),
ruled AS (SELECT *, substr(audit, opening, 1) = 'K' AND initials[opening] = 's' AS systemic FROM audits),
done AS (SELECT *, array_to_string(list_transform(list_filter(range(1, length(audit) + 1), lambda i: substr(audit, i, 1) <> 'D'), lambda i:
           CASE WHEN substr(audit, i, 1) = 'K' THEN roles[length(replace(substr(audit, 1, i), 'I', ''))]
                WHEN (length(replace(substr(audit, 1, i), 'D', '')) + CASE WHEN systemic THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN substr(audit, i, 1) = 'I' THEN '' ELSE texts[length(replace(substr(audit, 1, i), 'I', ''))] END), chr(10)) AS repaired FROM ruled)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(CAST(len(list_filter(range(1, n), lambda i: NOT (initials[i] || initials[i + 1]) IN ('su', 'ua', 'au'))) AS BIGINT), 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN done ON k.conv_id IS NOT DISTINCT FROM done.conv_id
"""
