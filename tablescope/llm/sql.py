"""The registered queries in SQL (DuckDB's dialect), where SQL can say them."""

from __future__ import annotations

from .secrets import BASE, KINDS, PATTERNS, SCOPE

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secret_rows(kind: int, pattern: str) -> str:
    p = _quoted(pattern)
    fit = "length(value) >= 6" if kind == 0 else "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')" if kind == 5 else "true"
    value = f"regexp_extract_all(t, {p}, 2)" if kind == 0 else f"regexp_extract_all(t, {p})"
    return f"""SELECT rid, {kind} AS kind, i, length(gap) AS gap, length(hit) AS size, {fit} AS fit FROM (
        SELECT rid, i, hits[i] AS hit, "values"[i] AS value, gaps[i] AS gap FROM (
            SELECT rid, hits, "values", gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
                SELECT rid, regexp_extract_all(t, {p}) AS hits, {value} AS "values", regexp_split_to_array(t, {p}) AS gaps FROM d)))"""


OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({" UNION ALL ".join(_secret_rows(k, p) for k, p in enumerate(PATTERNS))}),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM parts),
strong AS (SELECT *, e - size AS s, kind < {BASE} AND fit AS sure FROM placed),
ranged AS (SELECT *, max(CASE WHEN sure THEN e END) OVER (PARTITION BY rid ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached,
    min(CASE WHEN sure THEN s END) OVER (PARTITION BY rid ORDER BY s, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM strong),
weak AS (SELECT *, kind >= {BASE} AND fit AND coalesce(reached, 0) <= s AND coalesce(nxt, e) >= e AS able FROM ranged),
held AS (SELECT *, max(CASE WHEN able AND kind IN (3, 4) THEN e END) OVER (PARTITION BY rid ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder,
    min(CASE WHEN able AND kind IN (3, 4) THEN s END) OVER (PARTITION BY rid ORDER BY s, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS holds FROM weak),
free AS (SELECT *, able AND (kind <> 5 OR (coalesce(holder, 0) <= s AND coalesce(holds, e) >= e)) AS maybe FROM held),
scoped AS (SELECT *, max(CASE WHEN (sure OR maybe) AND kind IN (0, 2, 5) THEN 1 END) OVER w IS NOT NULL AS secret,
    max(CASE WHEN (sure OR maybe) AND kind IN (1, 3, 4) THEN 1 END) OVER w IS NOT NULL AS owner FROM free
    WINDOW w AS (PARTITION BY rid ORDER BY s RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING)),
told AS (SELECT *, list_value({", ".join(f"'{k}'" for k in KINDS)})[kind + 1] || ':' || s::VARCHAR || ':' || e::VARCHAR AS span,
    sure OR (maybe AND CASE WHEN kind = 5 THEN owner ELSE secret END) AS named FROM scoped)
SELECT doc_id, count(*) FILTER (WHERE sure AND kind = 0) AS n_assign, count(*) FILTER (WHERE sure AND kind = 1) AS n_access,
    count(*) FILTER (WHERE sure AND kind = 2) AS n_hex,
    sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE sure), '')) AS base_sha256,
    coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE named), '') AS spans
FROM d LEFT JOIN told USING (rid) GROUP BY rid, doc_id
"""


def near_copies(words: int, part: int, whole: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + {words - 1}], 'string_agg', ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {whole} * c >= {part} * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node WHERE reach.root < ways.b),
low AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""


OP5 = (
    near_copies(3, 85, 100)
    + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.root AS component_id, d.doc_id = low.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN low ON low.node = d.doc_id
"""
)


def repeats(length: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
spots AS (SELECT doc_id, i, list_aggregate(w[i:i + {length - 1}], 'string_agg', ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS i FROM d WHERE len(w) >= {length})),
twice AS (SELECT g FROM spots GROUP BY g HAVING count(*) > 1),
marked AS (SELECT doc_id, i FROM spots SEMI JOIN twice USING (g)),
words AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
judged AS (SELECT doc_id, i, word, coalesce(max(CASE WHEN m.i IS NOT NULL THEN 1 END)
    OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW), 0) AS gone
    FROM words LEFT JOIN marked m USING (doc_id, i))"""


OP6 = (
    repeats(35)
    + """
SELECT d.doc_id, count(word) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN judged USING (doc_id) GROUP BY d.doc_id
"""
)

SQL = {"op3_secrets": OP3, "op5_near_copies": OP5, "op6_repeats": OP6}


def _ways(place: int) -> str:
    """Cheapest treatment of a row from this place: (cost, edits, what is said from here on)."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    nxt, role = (2, 2, 3, 2)[place], ("user", "user", "assistant", "user")[place]
    kept = " ".join(f"WHEN q = '{initial}' THEN z{to}" for (at, initial), to in after.items() if at == place)
    ways = [f"struct_pack(c := 2 + z{place}.c, a := 'D' || z{place}.a, r := z{place}.r)",
            f"struct_pack(c := 1 + extra + z{nxt}.c, a := 'R' || z{nxt}.a, r := chr(10) || '{role}:' || text || z{nxt}.r)",
            f"""struct_pack(c := coalesce(extra + (CASE {kept} END).c, 1000000000), a := 'K' || coalesce((CASE {kept} END).a, ''),
                r := chr(10) || role || ':' || text || coalesce((CASE {kept} END).r, ''))"""]  # fmt: skip
    return f"list_sort([{', '.join(ways)}])[1] AS o{place}"


def _put_in(place: int) -> str:
    """The same, after up to two rows put in before the row."""
    nxt, role = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    one, two = nxt[place], nxt[nxt[place]]
    first = f"chr(10) || '{role[place]}:'"
    return f"""list_sort([o{place}, struct_pack(c := 5 + o{one}.c, a := 'I' || o{one}.a, r := {first} || o{one}.r),
        struct_pack(c := 10 + o{two}.c, a := 'II' || o{two}.a, r := {first} || chr(10) || '{role[one]}:' || o{two}.r)])[1] AS z{place}"""


OP11 = rf"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS bytes FROM conversations),
coded AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda d, e: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 20 AS f FROM base),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE r END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text,
    unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded WHERE f <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
again AS (SELECT *, left(role, 1) AS q, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS earlier FROM ordered),
marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN earlier THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(q) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM again),
priced AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM marked),
dp AS (SELECT conv_id, count(*) + 1 AS i, struct_pack(c := 0::BIGINT, a := '', r := '') AS z0,
        struct_pack(c := 10::BIGINT, a := 'II', r := chr(10) || 'user:' || chr(10) || 'assistant:') AS z1,
        struct_pack(c := 5::BIGINT, a := 'I', r := chr(10) || 'assistant:') AS z2, struct_pack(c := 0::BIGINT, a := '', r := '') AS z3
    FROM priced GROUP BY conv_id
    UNION ALL SELECT conv_id, i, {", ".join(map(_put_in, range(4)))} FROM (
        SELECT dp.conv_id, p.i, {", ".join(map(_ways, range(4)))} FROM dp JOIN priced p ON p.conv_id IS NOT DISTINCT FROM dp.conv_id AND p.i = dp.i - 1)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || q NOT IN ('su', 'ua', 'au')) AS illegal FROM priced GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(z0.c, 0) AS cost, coalesce(z0.a, '') AS audit, sha256(coalesce(z0.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN dp ON dp.i = 1 AND dp.conv_id IS NOT DISTINCT FROM o.conv_id
"""

SQL["op11_conversations"] = OP11

OP12 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM
    (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3), (4), (5)) s(k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM cand),
scored AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.f AS l, y.f AS r, n.n, ((1000 * c.a::HUGEINT * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN n USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM
    (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, (VALUES (2), (3), (4)) s(m) WHERE m < k)),
kept AS (SELECT * FROM weakest c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY rank <= 2000
"""

SQL["op12_collocations"] = OP12
