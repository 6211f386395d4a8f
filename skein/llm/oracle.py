"""SQL counterparts of the operator queries that SQL can express."""

from skein.llm.secret_scan import ALLOWED, BASE, CLASSES, weight

ORACLE: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE["op11_phrases"] = r"""
WITH pieces AS (
    SELECT doc_id, coalesce(lang, 'und') AS lang, piece, row_number() OVER () AS piece_id
    FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (
    SELECT lang, piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, size, array_to_string(list_slice(w, start, start + size - 1), ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS start
          FROM words, (SELECT unnest(range(1, 6)) AS size) AS sizes)
), frequent AS (
    SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 100
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS w FROM frequent WHERE size >= 2
), inner_phrases AS (
    SELECT lang, array_to_string(list_slice(w, start, start + k - 1), ' ') AS phrase, max(f) AS longer
    FROM (SELECT lang, w, f, k, unnest(range(1, CAST(size AS BIGINT) - k + 2)) AS start
          FROM (SELECT *, unnest(range(2, CAST(size AS BIGINT))) AS k FROM candidates WHERE size >= 3))
    GROUP BY ALL
), kept AS (
    SELECT c.* FROM candidates AS c LEFT JOIN inner_phrases AS i USING (lang, phrase)
    WHERE NOT coalesce(100 * i.longer >= 100 * c.f, false)
), cuts AS (
    SELECT lang, phrase, f, k, array_to_string(list_slice(w, 1, k), ' ') AS head,
        array_to_string(list_slice(w, k + 1, size), ' ') AS tail
    FROM (SELECT *, unnest(range(1, CAST(size AS BIGINT))) AS k FROM kept)
), scored AS (
    SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, n, c.k,
        CAST(CAST(1000 AS HUGEINT) * c.f * n // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
    FROM cuts AS c JOIN frequent AS h ON h.lang = c.lang AND h.phrase = head
    JOIN frequent AS t ON t.lang = c.lang AND t.phrase = tail JOIN totals AS n_words ON n_words.lang = c.lang
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
    phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


def _places(rank: int, pattern: str, group: int) -> str:
    """doc, start, rank, stop (code points from 0) and value of every match of a pattern."""
    found, p = f"f{rank}", quoted(pattern)
    return f"""{found}_all AS (
    SELECT doc, regexp_split_to_array(text, {p}) AS pieces, regexp_extract_all(text, {p}) AS whole,
        regexp_extract_all(text, {p}, {group}) AS part
    FROM texts WHERE regexp_matches(text, {p})
), {found} AS (
    SELECT doc, {rank} AS rank, value, CAST(stop - length(match) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
    FROM (SELECT doc, value, match, sum(length(piece) + length(match)) OVER (PARTITION BY doc ORDER BY i) AS stop
          FROM (SELECT doc, unnest(range(1, len(whole) + 1)) AS i, unnest(pieces[:len(whole)]) AS piece, unnest(whole) AS match, unnest(part) AS value
                FROM {found}_all))
)"""


def _windows(rank: int, kind) -> str:
    """Spans of the suspicious windows of one character class, every window counted anew."""
    sizes = ", ".join(str(weight(n)) for n in range(1, kind.window + 1))
    letters = ", ".join(f"({quoted(c)}, {k})" for k, same in enumerate(kind.alphabet) for c in same)
    harmless = " OR ".join(f"regexp_replace(value, {quoted(p)}, '', 'g') = ''" for p in ALLOWED)
    return f"""{_places(rank, kind.pattern, 0)}, w{rank} AS (
    SELECT doc, start + place AS start, start + place + {kind.window} AS stop
    FROM (SELECT doc, start, place, letter, count(*) AS n
          FROM (SELECT doc, start, value, unnest(range(0, length(value) - {kind.window - 1})) AS place FROM f{rank} WHERE NOT ({harmless})),
              range(0, {kind.window}) AS o(k), (VALUES {letters}) AS l(c, letter)
          WHERE c = substr(value, CAST(place + k + 1 AS BIGINT), 1) GROUP BY ALL)
    GROUP BY doc, start, place HAVING sum([{sizes}][n]) <= {kind.most}
), s{rank} AS (
    SELECT doc, {rank} AS rank, min(start) AS start, max(stop) AS stop
    FROM (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY start) AS run
          FROM (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                    THEN 0 ELSE 1 END AS new FROM w{rank}))
    GROUP BY doc, run
)"""


def _secret_scan() -> str:
    names = [k for k, *_ in BASE] + [c.kind for c in CLASSES]
    parts = [_places(k, pattern, group) for k, (_, pattern, group, _) in enumerate(BASE)]
    parts += [_windows(k, kind) for k, kind in enumerate(CLASSES, len(BASE))]
    base = " UNION ALL ".join(f"SELECT doc, rank, start, stop FROM f{k} WHERE length(value) >= {least}" for k, (_, _, _, least) in enumerate(BASE))
    more = " UNION ALL ".join(f"SELECT doc, rank, start, stop FROM s{k}" for k in range(len(BASE), len(names)))
    kinds = "[" + ", ".join(map(quoted, names)) + "]"
    joined = f"coalesce(string_agg({kinds}[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank){{}}, '')"
    counts = ", ".join(f"count(*) FILTER (rank = {k}) AS n_{name}" for k, (name, *_) in enumerate(BASE))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(parts)}, base AS ({base}), every AS ({base} UNION ALL {more})
SELECT doc_id, {counts}, sha256({joined.format(f" FILTER (rank < {len(BASE)})")}) AS base_sha256, {joined.format("")} AS spans
FROM texts LEFT JOIN every USING (doc) GROUP BY doc, doc_id
"""


ORACLE["op12_secret_scan"] = _secret_scan()


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op8_jaccard_join"] = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 2), ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS k FROM shingles GROUP BY doc_id
), links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
        FROM shingles AS x JOIN shingles AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN sizes AS p ON p.doc_id = a JOIN sizes AS q ON q.doc_id = b WHERE 100 * n >= 90 * (p.k + q.k - n)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT documents.doc_id, coalesce(k, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

_NAMES = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op9_decontamination"] = f"""
WITH item_words AS (
    SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_NAMES} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM item_words)
), words AS (
    SELECT row_number() OVER () AS doc, doc_id, {_NAMES} AS w FROM documents
), places AS (
    SELECT doc, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
    FROM (SELECT doc, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
    SELECT doc, s, k, item_id FROM places JOIN windows USING (k, g)
), hits AS (
    SELECT doc, count(DISTINCT p) AS n_hit FROM (SELECT doc, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc
), items AS (
    SELECT doc, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
    FROM (SELECT DISTINCT doc, item_id FROM found) GROUP BY doc
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc) LEFT JOIN items USING (doc)
"""
