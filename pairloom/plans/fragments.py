"""SQL fragments that the queries' SQL forms share (DuckDB dialect)."""

from __future__ import annotations

REC = """rec AS (SELECT doc_id AS id, substr(text, 1, 40) AS title, text AS body, [source, lang] AS tags, CASE WHEN doc_id % 10 <> 0 THEN lang END AS language,
 (['note', 'snippet', 'fact'])[1 + doc_id % 3] AS record_type, 1704067200 + doc_id * 60 AS created, CASE WHEN doc_id % 13 = 0 THEN 'draft' ELSE 'published' END AS status, source FROM documents)"""
VEC = "vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
SIM = "sim AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS raw, round(list_dot_product(a.v, b.v), 6) AS similarity FROM vec a JOIN vec b ON a.id < b.id)"
EDGE = """knn AS (SELECT src, dst, similarity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rk FROM
 (SELECT a AS src, b AS dst, similarity FROM sim WHERE raw >= 0.3 UNION ALL SELECT b, a, similarity FROM sim WHERE raw >= 0.3)) WHERE rk <= 3),
edge AS (SELECT k.src, k.dst, CASE WHEN a.label = b.label THEN 'supersedes' ELSE 'relates_to' END AS kind FROM knn k JOIN vec a ON a.id = k.src JOIN vec b ON b.id = k.dst),
adj AS (SELECT DISTINCT n, m FROM (SELECT src AS n, dst AS m FROM edge UNION ALL SELECT dst, src FROM edge) WHERE n <> m)"""
COMMON = """deg AS (SELECT n, count(*) AS degree FROM adj GROUP BY n),
common AS (SELECT a, b, c AS common, c / (x.degree + y.degree - c) AS jaccard FROM (SELECT x.n AS a, y.n AS b, count(*) AS c FROM adj x JOIN adj y ON x.m = y.m AND x.n < y.n GROUP BY 1, 2) JOIN deg x ON x.n = a JOIN deg y ON y.n = b)"""


def norm1(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def grams(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) < {n} THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length({t}) - {n - 2}), lambda i: substr({t}, i, {n}))) END"


def word_set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm1(x)}, ' '), lambda w: w <> ''))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / (len(list_distinct({a})) + len(list_distinct({b})) - len(list_intersect({a}, {b}))) END"


def containment(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN least(len({a}), len({b})) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END"


#: Pairs of records with equal normal title and source, and their given similarity.
PAIR = f"""keyed AS (SELECT *, {norm1("title")} AS k, {word_set("body")} AS ws FROM rec),
pair AS (SELECT a.id AS a, b.id AS b, round({jaccard("a.ws", "b.ws")}, 4) AS similarity FROM keyed a JOIN keyed b ON a.k = b.k AND a.source = b.source AND a.id < b.id)"""
FEAT = f"""gram AS (SELECT *, {grams("t", 3)} AS g3, {grams("t", 4)} AS g4, {grams("t", 5)} AS g5 FROM (SELECT *, {norm1("title || chr(10) || body")} AS t FROM rec WHERE id IN (SELECT a FROM pair UNION SELECT b FROM pair))),
feat AS (SELECT a || '--' || b AS pair_id, p.a, p.b, similarity, similarity::DOUBLE AS cos_target, {", ".join(f"round({jaccard(f'x.g{n}', f'y.g{n}')}, 6) AS char{n}_jaccard" for n in (3, 4, 5))},
 {", ".join(f"round({containment(f'x.g{n}', f'y.g{n}')}, 6) AS char{n}_containment" for n in (3, 4, 5))}, round({jaccard("x.tags", "y.tags")}, 6) AS tag_jaccard,
 abs(length(x.title) - length(y.title))::DOUBLE AS title_len_delta, abs(length(x.body) - length(y.body))::DOUBLE AS body_len_delta, abs(len(x.tags) - len(y.tags))::DOUBLE AS tag_count_delta,
 coalesce((x.record_type = y.record_type)::INT::DOUBLE, 0.0) AS type_match, coalesce((x.language = y.language)::INT::DOUBLE, 0.0) AS lang_match,
 x.title AS a_title, y.title AS b_title, x.body AS a_body, y.body AS b_body, x.record_type AS a_record_type, y.record_type AS b_record_type, x.language AS a_language, y.language AS b_language, x.tags AS a_tags, y.tags AS b_tags
 FROM pair p JOIN gram x ON x.id = p.a JOIN gram y ON y.id = p.b),
labelled AS (SELECT *, CASE WHEN {norm1("a_body")} = {norm1("b_body")} OR char5_jaccard >= 0.8 THEN 'duplicate' ELSE 'not-duplicate' END AS label FROM feat)"""
#: Rows with a truth and a closed-form probability.
SCORED = """scored AS (SELECT l.doc_id AS id, l.quality = 1 AS y, round(1 / (1 + exp(-(n_chars % 97 - 48) / 16.0)), 6) AS p, lang AS class, source FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
