"""SQL that several checks share, for DuckDB."""

from marrowlake.functions.stem import DOUBLED, STEP2, STEP3, STEP4
from marrowlake.functions.text import STOP_WORDS

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
CLASS = r"[ !@#$%^&*()_+={}\[\]:;<>,.?~/|''\"`-]+"


def toks(text: str) -> str:
    return f"string_split(regexp_replace(lower({text}), '{CLASS}', ' ', 'g'), ' ')"


FOLDED = "replace(replace(text, chr(10), ' '), chr(13), ' ')"
ONCE = "once AS (SELECT id, min(ord) ord, min(text) AS text, min(heading_path) heading_path, min(page_no) page_no, string_split(id, ':')[1] doc FROM chunks WHERE id IS NOT NULL GROUP BY id)"
USABLE = "len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
VEC = f"vec AS (SELECT id, max(embedding)::DOUBLE[] v FROM chunks WHERE id IS NOT NULL AND {USABLE} GROUP BY id)"
QUERIES = "q AS (SELECT doc_id AS query_id, id AS qdoc, title AS text FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)"
QVEC = "qv AS (SELECT query_id, v qv FROM q JOIN vec ON vec.id = qdoc || ':0')"

# ---- Porter's steps over distinct words, by the shape of a word: V for a vowel, C for a consonant ----


def _shape(w: str) -> str:
    """y is a vowel behind a consonant; runs of y are settled from the left."""
    s = f"regexp_replace(regexp_replace(regexp_replace({w}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):
        s = f"regexp_replace(regexp_replace({s}, 'Cy', 'CV', 'g'), 'Vy', 'VC', 'g')"
    return s


def _cut(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _measure(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'V+C'))"


def _cvc(w: str, shape: str) -> str:
    return f"(length({w}) > 2 AND right({shape}, 3) = 'CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"


def _ends(w: str, ends) -> str:
    return "(" + " OR ".join(f"ends_with({w}, '{e}')" for e in ends) + ")"


def _longest_first(rules) -> list[str]:
    return sorted(rules, key=lambda r: (-len(r), r))


def _swap(rules: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN {_measure(_cut('s', len(e)))} >= 1 THEN {_cut('w', len(e))} || '{rules[e]}' ELSE w END" for e in _longest_first(rules)) + " ELSE w END"


def _dropped(e: str) -> str:
    extra = f" AND {_ends(_cut('w', len(e)), 'st')}" if e == "ion" else ""
    return f"WHEN ends_with(w, '{e}') THEN CASE WHEN {_measure(_cut('s', len(e)))} > 1{extra} THEN {_cut('w', len(e))} ELSE w END"


def _step(n: int, expression: str) -> str:
    return f"p{n} AS (SELECT t, w, {_shape('w')} s FROM (SELECT t, {expression} w FROM p{n - 1}))"


def stems(source: str) -> str:
    """CTEs that end in stem (t, stem) of the distinct t of source; stems that are empty are left out."""
    ed = f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(_cut('s', 3))} > 0 THEN {_cut('w', 1)} ELSE w END " + " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN contains({_cut('s', len(e))}, 'V') THEN {_cut('w', len(e))} || '+' ELSE w END" for e in ("ed", "ing")) + " ELSE w END"
    b, bs = _cut("w", 1), "left(s, length(s) - 1)"  # a word that lost ed or ing carries a plus sign
    mend = f"""CASE WHEN NOT ends_with(w, '+') THEN w WHEN {_ends(b, ('at', 'bl', 'iz'))} THEN {b} || 'e' WHEN {_ends(b, sorted(DOUBLED))} THEN {_cut('w', 2)}
  WHEN {_measure(bs)} = 1 AND {_cvc(b, bs)} THEN {b} || 'e' ELSE {b} END"""
    return ", ".join(
        (
            f"p0 AS (SELECT DISTINCT t, t AS w FROM {source} WHERE t <> '')",
            _step(1, f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut('w', 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut('w', 1)} ELSE w END"),
            _step(2, ed),
            _step(3, mend),
            _step(4, f"CASE WHEN ends_with(w, 'y') AND contains({_cut('s', 1)}, 'V') THEN {_cut('w', 1)} || 'i' ELSE w END"),
            _step(5, _swap(STEP2)),
            _step(6, _swap(STEP3)),
            _step(7, "CASE " + " ".join(_dropped(e) for e in _longest_first(STEP4)) + " ELSE w END"),
            _step(8, f"CASE WHEN ends_with(w, 'e') AND ({_measure(_cut('s', 1))} > 1 OR ({_measure(_cut('s', 1))} = 1 AND NOT {_cvc(_cut('w', 1), _cut('s', 1))})) THEN {_cut('w', 1)} ELSE w END"),
            _step(9, f"CASE WHEN ends_with(w, 'll') AND {_measure(_cut('s', 1))} > 1 THEN {_cut('w', 1)} ELSE w END"),
            "stem AS (SELECT t, w AS stem FROM p9 WHERE w <> '')",
        )
    )


_TOKENS = f"tok AS (SELECT id, t FROM (SELECT id, unnest({toks(FOLDED)}) t FROM once WHERE text IS NOT NULL) WHERE t <> '' AND t NOT IN ({STOP}))"
_ASKED = f"asked AS (SELECT query_id, t FROM (SELECT query_id, unnest({toks('text')}) t FROM q) WHERE t <> '' AND t NOT IN ({STOP}))"
_SCORED = """dl AS (SELECT id, sum(tf) dl FROM tf GROUP BY 1), df AS (SELECT term, count(*) df FROM tf GROUP BY 1), n AS (SELECT count(*) n FROM once), tt AS (SELECT sum(tf) tt FROM tf),
 postings AS (SELECT term, id, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (tt / n))) impact FROM tf JOIN dl USING (id) JOIN df USING (term), n, tt)"""
#: The index of stemmed terms, of all chunks and the query set; needs once and q.
POSTINGS = f"{_TOKENS}, {_ASKED}, {stems('(SELECT t FROM tok UNION SELECT t FROM asked)')}, tf AS (SELECT id, stem AS term, count(*) tf FROM tok JOIN stem USING (t) GROUP BY 1, 2), {_SCORED}"
#: The same without the stemmer.
POSTINGS_UNSTEMMED = f"{_TOKENS}, {_ASKED}, stem AS (SELECT DISTINCT t, t AS stem FROM (SELECT t FROM tok UNION SELECT t FROM asked)), tf AS (SELECT id, t AS term, count(*) tf FROM tok GROUP BY 1, 2), {_SCORED}"
REL = "least(greatest((1 + cosine) / 2, 0.0), 1.0)"


def knn(k: int) -> str:
    return f"""cosq AS (SELECT query_id, vec.id, round(list_cosine_similarity(qv, v), 12) cosine FROM qv, vec),
 near AS (SELECT query_id, id, cosine, {REL} relevance, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) p FROM cosq QUALIFY p <= {k})"""


def words(k: int) -> str:
    return f"""qt AS (SELECT query_id, stem AS term, count(*) times FROM asked JOIN stem USING (t) GROUP BY 1, 2),
 bm AS (SELECT query_id, id, round(sum(impact * times), 9) score FROM qt JOIN postings USING (term) GROUP BY 1, 2),
 kw AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) p FROM bm QUALIFY p <= {k})"""


TITLE_KEY, STEM_KEY = "nullif(lower(trim(title)), '')", "nullif(lower(trim(string_split(string_split(uri, '/')[-1], '.')[1])), '')"
EDGES = f"""keys AS (SELECT DISTINCT id, k AS key FROM (SELECT id, unnest([{TITLE_KEY}, {STEM_KEY}, nullif(lower(trim(json_extract_string(meta, '$.id'))), '')]) k FROM documents) WHERE k IS NOT NULL),
 uniq AS (SELECT key, min(id) id FROM keys GROUP BY key HAVING count(*) = 1),
 named AS (SELECT id AS src, lower(trim(l)) AS key, 'wikilink' AS kind FROM (SELECT id, unnest(links) l FROM documents)
  UNION ALL SELECT id, lower(trim(json_extract_string(meta, '$.supersedes'))), 'supersedes' FROM documents UNION ALL SELECT id, lower(trim(json_extract_string(meta, '$.superseded_by'))), 'superseded-by' FROM documents),
 edges AS (SELECT DISTINCT src, uniq.id AS dst, kind FROM named JOIN uniq USING (key) WHERE src <> uniq.id),
 inb AS (SELECT dst AS id, count(*) inbound FROM edges WHERE kind = 'wikilink' GROUP BY 1)"""
LIFE = """CASE WHEN s IS NULL THEN 0 WHEN s IN ('accepted', 'active', '') THEN 0 WHEN s = 'investigating' THEN 1 WHEN s = 'superseded' THEN 3 WHEN coalesce(inbound, 0) > 0 THEN 1 ELSE 2 END"""
LIFECYCLES = f"life AS (SELECT id, {LIFE} lifecycle FROM (SELECT id, lower(trim(json_extract_string(meta, '$.status'))) s FROM documents) LEFT JOIN inb USING (id))"


# The tables' own links name no document, so the graph queries add to them: every document links to the title of another one (by a rule on
# doc_id; titles that several documents share lead nowhere), and two thirds are superseded by or supersede that one.
_PARTNER = "(a.doc_id * 7 + 3) % (SELECT count(*) FROM documents) + 1"
LINKED_EDGES = EDGES.replace("unnest(links) l FROM documents)", f"unnest(links) l FROM documents UNION ALL SELECT a.id, b.title FROM documents a JOIN documents b ON b.doc_id = {_PARTNER})").replace(
    "FROM named JOIN uniq USING (key) WHERE src <> uniq.id)",
    f"FROM named JOIN uniq USING (key) WHERE src <> uniq.id UNION SELECT a.id, b.id, CASE a.doc_id % 3 WHEN 1 THEN 'superseded-by' ELSE 'supersedes' END FROM documents a JOIN documents b ON b.doc_id = {_PARTNER} WHERE a.doc_id % 3 > 0 AND a.id <> b.id)",
)


def mmr(cand: str, lam: float, take: int = 10) -> str:
    """CTEs that end in picked (query_id, position, id): greedy choice among cand (query_id, id, doc, text, p), one recursive step a position."""
    return rf"""mc AS (SELECT query_id, id, doc, p, count(*) OVER (PARTITION BY query_id) n, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) w FROM {cand}),
 ms AS (SELECT a.query_id, a.id, map_from_entries(list((b.id, least(1.0, 0.6 * CAST(a.doc = b.doc AS INTEGER) + 0.4 * CASE WHEN len(a.w) + len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) ELSE 0.0 END)))) m
  FROM mc a JOIN mc b ON b.query_id = a.query_id AND b.id <> a.id GROUP BY 1, 2),
 mv AS (SELECT mc.query_id, mc.id, p, CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (p - 1) / (n - 1)::DOUBLE END norm, m FROM mc LEFT JOIN ms USING (query_id, id)),
 mr AS (SELECT DISTINCT query_id, 0 step, []::VARCHAR[] chosen FROM mc UNION ALL
  SELECT query_id, step + 1, list_append(chosen, best) FROM (SELECT mr.query_id, step, chosen, arg_max(mv.id, ({lam}::DOUBLE * norm - (1::DOUBLE - {lam}::DOUBLE) * coalesce(list_max(list_transform(chosen, lambda x: m[x])), 0.0::DOUBLE), -p)) best
   FROM mr JOIN mv ON mv.query_id = mr.query_id AND NOT list_contains(chosen, mv.id) WHERE step < {take} GROUP BY 1, 2, 3)),
 last AS (SELECT query_id, arg_max(chosen, step) chosen FROM mr GROUP BY 1), picked AS (SELECT query_id, unnest(chosen) id, CAST(generate_subscripts(chosen, 1) AS INTEGER) AS position FROM last)"""


def expansion(hops: int, most: int) -> str:
    """CTEs adj, lnk and mixed (query_id, id): what lies beside and behind seeds (query_id, chunk_id, doc, ord)."""
    reach = "SELECT s.query_id, f.dst doc FROM seeds s JOIN foll f ON f.src = s.doc" + (" UNION SELECT s.query_id, g.dst FROM seeds s JOIN foll f ON f.src = s.doc JOIN foll g ON g.src = f.dst" if hops > 1 else "")
    free = "NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = {t}.query_id AND z.chunk_id = o.id)"
    return f"""adj AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc, ord) p FROM (SELECT DISTINCT s.query_id, o.id, o.doc, o.ord FROM seeds s JOIN once o ON o.doc = s.doc AND abs(o.ord - s.ord) BETWEEN 1 AND {hops} WHERE {free.format(t='s')}) QUALIFY p <= {most}),
 foll AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('wikilink', 'superseded-by')), reach AS ({reach}),
 lnk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc, ord) p FROM (SELECT DISTINCT r.query_id, o.id, o.doc, o.ord FROM reach r JOIN once o ON o.doc = r.doc AND o.ord = 0 WHERE {free.format(t='r')}) QUALIFY p <= {most}),
 mixed AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY k) p FROM (SELECT query_id, id, min((p, l)) k FROM (SELECT query_id, id, p, 0 l FROM adj UNION ALL SELECT query_id, id, p, 1 FROM lnk) GROUP BY 1, 2) QUALIFY p <= {most})"""


def tier(candidates: int, hops: int, neighbours: int, lam: float, weight: str = "1.0", gate: float = 0.0, extra: str = "") -> str:
    """CTEs of a whole search that end in picked, with weighted (query_id, id, relevance, title, heading_path, page_no, uri, text). weight multiplies the usual weights."""
    graph = f"seeds AS (SELECT query_id, o.id AS chunk_id, o.doc, o.ord FROM near JOIN once o ON o.id = near.id WHERE p <= 5), {expansion(hops, neighbours)}, " if hops else ""
    more = " UNION ALL SELECT query_id, id, NULL FROM mixed" if hops else ""
    return f"""WITH RECURSIVE {ONCE}, {VEC}, {QUERIES}, {QVEC}, {POSTINGS}, {knn(candidates)}, {words(candidates)}, {EDGES}, {LIFECYCLES}, {graph}{extra}
 lists AS (SELECT query_id, id, relevance FROM near UNION ALL SELECT query_id, id, NULL FROM kw{more}), fused AS (SELECT query_id, id, coalesce(max(relevance), 0.0) relevance FROM lists GROUP BY 1, 2),
 pool AS (SELECT f.query_id, f.id, CASE WHEN f.relevance > 0 THEN f.relevance ELSE coalesce({REL.replace('cosine', 'c.cosine')}, 0.0) END relevance FROM fused f LEFT JOIN cosq c ON c.query_id = f.query_id AND c.id = f.id),
 weighted AS (SELECT query_id, p.id, round(relevance * (CASE WHEN source_type = 'transcript' THEN 0.45 ELSE 1.0 END * CASE WHEN lifecycle = 3 THEN 0.88 ELSE 1.0 END * {weight}), 12) relevance, o.doc, title, o.heading_path, o.page_no, uri, o.text
  FROM pool p JOIN once o ON o.id = p.id JOIN documents d ON d.id = o.doc JOIN life ON life.id = o.doc),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) p FROM weighted WHERE relevance >= {gate}), {mmr('ordered', lam)}"""
