"""DuckDB SQL that says the same as the queries."""

from __future__ import annotations

from shotline.functions.text import STOP_WORDS
from shotline.plans.queries import RESPONSES

_F = """f AS (SELECT vec_id AS point_id, embedding::DOUBLE[] AS v, label, 'V' || lpad(label::VARCHAR, 3, '0') || '.mp4' AS source_file,
    (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 4 AS frame_idx, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 5 AS scene_id,
    (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 4 / 25.0::DOUBLE AS timestamp, (vec_id % 11) / 10.0::DOUBLE AS sharpness FROM embeddings),
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 50 = 0)"""


def _top(name: str, queries: str, frames: str, k: int, q: str = "q.v", v: str = "f.v") -> str:
    """A CTE of the k best frames of each query."""
    return f"""{name} AS (SELECT query_id, point_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id)::INTEGER AS rank
        FROM (SELECT q.query_id, f.point_id, round(list_cosine_similarity({q}, {v}), 9) AS score FROM {queries} q CROSS JOIN {frames} f)) WHERE rank <= {k})"""


_H = f"WITH {_F}, {_top('h', 'q', 'f', 20)}"
_OUT = "SELECT query_id, point_id, round(score, 6) AS score, rank FROM"
_TOK = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2))"
_FIRST = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:3], ' ')"
_T = rf"""tq AS (SELECT doc_id AS query_id, {_TOK.format(_FIRST)} AS t FROM documents WHERE doc_id % 100 = 0),
    tx AS (SELECT doc_id AS point_id, text, {_TOK.format("text")} AS t FROM documents),
    tm AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY point_id)::INTEGER AS rank FROM tq JOIN tx ON len(tq.t) > 0 AND list_has_all(tx.t, tq.t)),
    tk AS (SELECT *, 1.0::DOUBLE / rank AS score FROM tm WHERE rank <= 20)"""
_S = """s AS (SELECT user_id::VARCHAR AS source_file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, (event_id % 10) / 10.0::DOUBLE AS prob, value, event_id FROM events),
    z AS (SELECT source_file, frame_idx // 20 AS scene_id, frame_idx AS i, round(coalesce(value, 0), 2) AS size FROM s)"""
_SUB = """s AS (SELECT user_id % 5 AS team, user_id % 7 AS task, 'v' || (event_id % 20)::VARCHAR AS video, ts, event_id AS id, event_type = 'purchase' AS correct, (floor(epoch(ts))::BIGINT % 300)::DOUBLE AS t FROM events)"""
_AVS = f"""WITH {_SUB}, p AS (SELECT team, task, video, max(correct::INT) AS c, sum((NOT correct)::INT) AS i FROM s GROUP BY ALL),
    n AS (SELECT task, count(DISTINCT video) AS n FROM s WHERE correct GROUP BY task),
    a AS (SELECT team, task, sum(c - 0.2::DOUBLE * i) AS x FROM p GROUP BY ALL),
    w AS (SELECT team, task, CASE WHEN n > 0 THEN 1000 * greatest(x / n, 0) ELSE 0 END AS score FROM a LEFT JOIN n USING (task))"""
_RRF = """u AS (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 AS l FROM b),
    r AS (SELECT query_id, point_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000 + rank) AS first, bool_or(l = 0) AS x, bool_or(l = 1) AS y FROM u GROUP BY ALL),
    fused AS (SELECT query_id, point_id, score, x, y, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, point_id)::INTEGER AS rank FROM r)"""
_HYBRID = f"WITH {_F}, q100 AS (SELECT * FROM q WHERE query_id % 100 = 0), {_T}, {_top('a', 'q100', 'f', 20)}, b AS (SELECT query_id, point_id, score, rank FROM tk), {_RRF}"
_PLACED = "p AS (SELECT h.*, source_file, frame_idx, scene_id FROM h JOIN f USING (point_id))"
_COH = """SELECT *, score + 0.3::DOUBLE * (sum(score) OVER (PARTITION BY query_id, source_file ORDER BY frame_idx RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - score) AS boosted FROM p"""


def _raw() -> str:
    """The responses as an SQL expression of event_id and user_id."""
    c, u = "((event_id % 10) / 10.0::DOUBLE)::VARCHAR", "user_id::VARCHAR"
    quote = lambda x: "'" + x.format(c="<c>", u="<u>").replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    cases = " ".join(f"WHEN {k} THEN replace(replace({quote(x)}, '<c>', {c}), '<u>', {u})" for k, x in enumerate(RESPONSES))
    return f"CASE event_id % {len(RESPONSES)} {cases} END"


def _checked(source: str, keys: str) -> str:
    """CTEs that end in checked: keys of source with the outcome of its raw responses."""
    return f"""gt AS (SELECT {keys}, trim(regexp_replace(regexp_replace(regexp_replace(trim(raw), '^```[^\\n]*\\n', ''), '^```', ''), '```$', '')) AS t FROM {source}),
    gj AS (SELECT {keys}, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM gt),
    gk AS (SELECT {keys}, json_type(j) AS kind, json_type(j, '$.found') = 'BOOLEAN' AND json_extract_string(j, '$.found') = 'true' AS found,
        CASE WHEN json_type(j, '$.answer') = 'VARCHAR' THEN trim(json_extract_string(j, '$.answer')) END AS answer,
        CASE WHEN json_type(j, '$.confidence') <> 'BOOLEAN' THEN try_cast(json_extract_string(j, '$.confidence') AS DOUBLE) END AS c FROM gj),
    go AS (SELECT *, CASE WHEN kind IS NULL OR kind <> 'OBJECT' THEN 'malformed_response' WHEN NOT coalesce(found, false) THEN 'answer_not_found' WHEN coalesce(answer, '') = '' THEN 'missing_answer'
        WHEN upper(answer) IN ('UNKNOWN', 'N/A', 'NA', 'NONE', 'NULL') THEN 'unknown_answer' WHEN c IS NULL THEN 'invalid_confidence' WHEN isnan(c) OR c < 0 OR c > 1 THEN 'confidence_out_of_range' END AS reason FROM gk),
    checked AS (SELECT {keys}, reason IS NULL AS valid, CASE WHEN reason IS NULL THEN answer END AS answer, CASE WHEN reason IS NULL THEN c ELSE 0 END AS confidence, reason FROM go)"""


_GROUNDED = f"WITH ge AS (SELECT event_id, {_raw()} AS raw FROM events), {_checked('ge', 'event_id')}, r AS (SELECT * FROM checked)"
_SHOT = "source_file || ':shot:' || lpad(scene_id::VARCHAR, 6, '0')"
_SHOTS = f"""su AS (SELECT source_file, scene_id, point_id, 0.75::DOUBLE + 0.25::DOUBLE * sharpness AS w, unnest(v) AS x, unnest(range(1, 65)) AS d FROM f),
    sd AS (SELECT source_file, scene_id, d, sum(w * x) / sum(w) AS x FROM su GROUP BY ALL),
    sv AS (SELECT {_SHOT} AS shot_id, source_file, scene_id, list(x ORDER BY d) AS v FROM sd GROUP BY ALL)"""
_UNIT = """uu AS (SELECT source_file, scene_id, point_id, unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) AS x, unnest(range(1, 65)) AS d FROM f),
    us AS (SELECT source_file, scene_id, d, sum(x) AS x, count(*) AS n FROM uu GROUP BY ALL),
    ul AS (SELECT source_file, scene_id, list(x ORDER BY d) AS s, max(n) AS n FROM us GROUP BY ALL)"""
_EVENTS = """ev AS (SELECT vec_id - vec_id % 100 AS query_id, (vec_id % 100)::INTEGER AS event, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 < 3)"""


def _step(i: int) -> str:
    """Hits of event i in temporal_chain."""
    top = _top(f"t{i}", f"(SELECT * FROM ev WHERE event = {i})", "f", 40)
    return f"{top}, h{i} AS (SELECT query_id, source_file, frame_idx, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM t{i} JOIN f USING (point_id))"


def _chained(i: int) -> str:
    """Best chains up to step i of temporal_chain."""
    return f"""c{i} AS (SELECT query_id, source_file, frame_idx, total, path FROM (SELECT h.query_id, h.source_file, h.frame_idx, c.total + h.score AS total, list_append(c.path, h.frame_idx) AS path,
        row_number() OVER (PARTITION BY h.query_id, h.source_file, h.frame_idx ORDER BY round(c.total, 9) DESC, c.frame_idx) AS n
        FROM h{i} h JOIN c{i - 1} c ON c.query_id = h.query_id AND c.source_file = h.source_file AND h.frame_idx > c.frame_idx AND h.frame_idx - c.frame_idx <= 150) WHERE n = 1)"""


def _aligned(i: int) -> str:
    """States of event_alignment after event i."""
    return f"""d{i} AS (SELECT * EXCLUDE (b), CASE WHEN b IS NOT NULL THEN {{'total': round(b.total + sims[{i + 1}], 9), 'j': j, 'path': list_append(b.path, frame_idx)}} END AS d FROM
        (SELECT * EXCLUDE (d), max(d) OVER (PARTITION BY query_id, source_file ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d{i - 1}))"""


_STOPS = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]"
_STEEP = lambda f, g: f"coalesce(CASE WHEN most > 0 THEN (100 * abs(size - {f}(size, {g}) OVER w) / most) / sqrt({g * g}.0::DOUBLE + (100 * abs(size - {f}(size, {g}) OVER w) / most) * (100 * abs(size - {f}(size, {g}) OVER w) / most)) ELSE 0 END, 0)"


def _box(k: int) -> str:
    """Box k of box_nms as a list of one struct; inter: area shared with another box o."""
    c = lambda j: f"c[{8 * k + j + 1}]"
    corners = f"'x1': least({c(0)}, {c(2)}), 'y1': least({c(1)}, {c(3)}), 'x2': greatest({c(0)}, {c(2)}), 'y2': greatest({c(1)}, {c(3)})"
    return f"{{'k': -v[{8 * k + 5}], 'label': CASE WHEN v[{8 * k + 6}] + v[{8 * k + 7}] + v[{8 * k + 8}] > 0 THEN 'L1' ELSE 'L0' END, {corners}, 'conf': v[{8 * k + 5}]}}"


_INTER = "(greatest(least(o.x2, b[1].x2) - greatest(o.x1, b[1].x1), 0) * greatest(least(o.y2, b[1].y2) - greatest(o.y1, b[1].y1), 0))"
_AREAS = "((o.x2 - o.x1) * (o.y2 - o.y1) + (b[1].x2 - b[1].x1) * (b[1].y2 - b[1].y1))"



def _fuse(name: str, *lists: str, labels: tuple[str, ...] = ()) -> str:
    """A CTE that fuses ranked lists (query_id, point_id, rank)."""
    union = " UNION ALL ".join(f"SELECT query_id, point_id, rank, {i} AS l, '{labels[i] if labels else i}' AS label FROM {x}" for i, x in enumerate(lists))
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, point_id)::INTEGER AS rank FROM
        (SELECT query_id, point_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 100000 + rank) AS first, string_agg(label, ',' ORDER BY l) AS via FROM ({union}) GROUP BY ALL))"""


def _tokens(name: str, words: str, k: int) -> str:
    """A CTE of the first k frames with all tokens of each query's words."""
    return f"""{name} AS (SELECT * FROM (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY point_id)::INTEGER AS rank FROM (SELECT query_id, {_TOK.format(words)} AS t FROM ask) a JOIN ft ON len(a.t) > 0 AND list_has_all(ft.t, a.t)) WHERE rank <= {k})"""


_ASK = rf"""ask AS (SELECT q.query_id, ((q.query_id % 150) / 50 + 1)::INTEGER AS type, q.v, h.v AS hv, array_to_string(w[1:3], ' ') AS text, array_to_string(w[4:5], ' ') AS hyde FROM q LEFT JOIN f h ON h.point_id = q.query_id + 1
        LEFT JOIN (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents) d ON d.doc_id = q.query_id),
    ft AS (SELECT f.*, text, {_TOK.format("text")} AS t FROM f LEFT JOIN documents ON doc_id = f.point_id)"""


def _retrieved(name: str, k: int) -> str:
    """CTEs of the nested fusion of k hits from each source, with places."""
    n = name
    return f"""{_top(n + 'd', 'ask', 'f', k)}, {_top(n + 'h', '(SELECT query_id, hv AS v FROM ask WHERE hv IS NOT NULL)', 'f', k)}, {_top(n + 's', 'ask', 'f', k, 'q.v[1:16]', 'f.v[1:16]')},
    {_tokens(n + 't', 'text', k)}, {_tokens(n + 'u', 'hyde', k)}, {_fuse(n + '1', n + 'd', n + 't')}, {_fuse(n + '2', n + 'h', n + 'u')},
    {_fuse(n + '3', n + '1', n + '2', n + 's', labels=('query', 'hyde', 'secondary'))}, {name} AS (SELECT r.*, source_file, frame_idx, scene_id, timestamp, text, t, label FROM {n}3 r JOIN ft USING (point_id))"""


def _scenes(name: str, source: str, score: str, k: int) -> str:
    """A CTE of the best hit of each scene, the k best of them."""
    return f"""{name} AS (SELECT * FROM (SELECT * EXCLUDE (rank, n), row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, point_id)::INTEGER AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id, source_file, scene_id ORDER BY round({score}, 9) DESC, point_id) AS n FROM {source}) WHERE n = 1) WHERE rank <= {k})"""


_SAID = "CASE WHEN point_id % 17 <> 0 THEN CASE WHEN (point_id * 7 + query_id) % 11 <= 10 THEN ((point_id * 7 + query_id) % 11) / 10.0::DOUBLE END END"
_ANSWERED = """CASE point_id % 3 WHEN 1 THEN 'sorry' WHEN 2 THEN '{"found": false}' ELSE '{"found": true, "answer": "p' || point_id || '", "confidence": ' || ((point_id * 3 % 10) / 10.0::DOUBLE)::VARCHAR || '}' END"""


def _answers(source: str) -> str:
    """CTEs that end in vqa: rows of source with checked answers and the score they give."""
    return f"""raw AS (SELECT query_id, point_id, {_ANSWERED} AS raw FROM {source}), {_checked('raw', 'query_id, point_id')},
    vqa AS (SELECT s.*, CASE WHEN label % 4 <> 3 AND valid THEN c.answer ELSE 'UNKNOWN' END AS said, 0.4::DOUBLE * score + 0.6::DOUBLE * CASE WHEN label % 4 <> 3 THEN confidence ELSE 0 END AS final FROM {source} s JOIN checked c USING (query_id, point_id))"""


def _sequenced(source: str) -> str:
    """CTEs that end in seq: the events of queries of type 3 aligned with their best videos of source."""
    return f"""bv AS (SELECT * FROM (SELECT query_id, source_file, row_number() OVER (PARTITION BY query_id ORDER BY round(max(score), 9) DESC, source_file) AS n FROM {source} WHERE query_id % 150 = 100 GROUP BY query_id, source_file) WHERE n <= 20),
    ev AS (SELECT vec_id - vec_id % 50 AS query_id, vec_id % 50 AS event, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 < 3),
    es AS (SELECT bv.query_id, bv.source_file, frame_idx, timestamp, point_id, list(round(list_cosine_similarity(ev.v, f.v), 9) ORDER BY event) AS sims FROM bv JOIN ev USING (query_id) JOIN f USING (source_file) GROUP BY ALL),
    er AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY frame_idx, point_id) AS j FROM es),
    d0 AS (SELECT *, {{'total': sims[1], 'j': j, 'path': [frame_idx]}} AS d FROM er), {_aligned(1)}, {_aligned(2)},
    eo AS (SELECT query_id, source_file, max(d) AS d FROM d2 WHERE d IS NOT NULL GROUP BY ALL),
    seq AS (SELECT query_id, source_file, d.total / 3 AS score, d.path AS path, row_number() OVER (PARTITION BY query_id ORDER BY round(d.total / 3, 9) DESC, source_file)::INTEGER AS rank FROM eo)"""


_BATCH = f"""WITH {_F}, {_ASK}, {_retrieved('r', 100)}, {_scenes('s', 'r', 'score', 100)},
    one AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank > 20, CASE WHEN rank > 20 THEN 0 ELSE round(coalesce({_SAID}, 0), 9) END DESC, rank)::INTEGER AS place FROM s WHERE query_id % 150 = 0),
    two AS (SELECT query_id, point_id, score, source_file FROM s WHERE query_id % 150 = 50),
    tv AS (SELECT query_id, source_file, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, source_file) AS n FROM two GROUP BY query_id, source_file),
    tc AS (SELECT tv.query_id, f.point_id, f.source_file, round(list_cosine_similarity(q.v, f.v), 9) AS cos FROM tv JOIN q USING (query_id) JOIN f ON f.source_file = tv.source_file WHERE tv.n <= 5 AND NOT EXISTS (SELECT 1 FROM two WHERE two.query_id = tv.query_id AND two.point_id = f.point_id)),
    tm AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY cos DESC, point_id) AS n FROM tc),
    tu AS (SELECT query_id, point_id, score FROM two UNION ALL SELECT query_id, point_id, cos / 61 FROM tm WHERE n <= 5),
    tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, point_id)::INTEGER AS rank FROM tu),
    tw AS (SELECT tr.*, f.source_file, f.frame_idx, f.timestamp, f.label FROM tr JOIN f USING (point_id) WHERE rank <= 100), th AS (SELECT * FROM tw WHERE rank <= 20), {_answers('th')},
    tp AS (SELECT tw.*, said, row_number() OVER (PARTITION BY tw.query_id ORDER BY tw.rank > 20, CASE WHEN tw.rank > 20 THEN 0 ELSE round(final, 9) END DESC, tw.rank)::INTEGER AS place FROM tw LEFT JOIN (SELECT query_id, point_id, said, final FROM vqa) USING (query_id, point_id)),
    {_sequenced('s')},
    results AS (SELECT query_id, 1 AS type, place AS rank, source_file, frame_idx, NULL AS path, source_file || ', ' || frame_idx AS answer FROM one
        UNION ALL SELECT tp.query_id, 2, tp.place, tp.source_file, tp.frame_idx, NULL, tp.source_file || ', ' || tp.frame_idx || ', ' || b.said FROM tp JOIN (SELECT query_id, said FROM tp WHERE place = 1) b USING (query_id)
        UNION ALL SELECT query_id, 3, rank, source_file, NULL, path, source_file || ', ' || array_to_string(path, ', ') FROM seq)"""

SQL: dict[str, str] = {
    "knn_exact": f"{_H} {_OUT} h",
    "knn_filtered": f"WITH {_F}, g AS (SELECT * FROM f WHERE source_file IN ('V001.mp4', 'V003.mp4', 'V005.mp4')), {_top('h', 'q', 'g', 10)} {_OUT} h",
    "knn_by_example": f"WITH {_F}, e AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 60 = 7), {_top('h', 'e', 'f', 5)} {_OUT} h",
    "knn_cells_exact": f"WITH {_F}, {_top('h', 'q', 'f', 10)} {_OUT} h",
    "clip_search": f"""WITH {_F}, {_top('h', 'q', 'f', 10)},
        b AS (SELECT query_id - query_id % 200 AS query_id, point_id, max(score) AS score, arg_min(query_id, (-score, query_id)) AS clip_ts FROM h GROUP BY query_id - query_id % 200, point_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id)::INTEGER AS rank FROM b)
        SELECT query_id, point_id, round(score, 6) AS score, clip_ts, rank FROM r WHERE rank <= 10""",
    "truncation_recall": f"""WITH {_F}, {_top('full', 'q', 'f', 10)}, """.replace("full AS", "best AS")
    + ", ".join(_top(f"t{d}", "q", "f", 10, f"q.v[1:{d}]", f"f.v[1:{d}]") for d in (8, 16, 32))
    + " "
    + " UNION ALL ".join(f"SELECT {d} AS dim, round(count(*) / (SELECT count(*) FROM best), 6) AS recall FROM t{d} JOIN best USING (query_id, point_id)" for d in (8, 16, 32)),
    "scene_variance": f"""WITH {_F}, u AS (SELECT source_file, scene_id, point_id, unnest(v) AS x, unnest(range(1, 65)) AS d FROM f),
        d AS (SELECT source_file, scene_id, d, var_pop(x) AS var, count(*) AS n FROM u GROUP BY ALL),
        s AS (SELECT source_file, scene_id, max(n) AS n, avg(var) AS variance FROM d GROUP BY ALL)
        SELECT source_file, scene_id, n, round(variance, 6) AS variance, CASE WHEN variance < 0.01 THEN 1 WHEN variance < 0.05 THEN 2 ELSE least(8, greatest(1, floor(variance * 100)))::INTEGER END AS budget FROM s""",
    "token_match": f"WITH {_T} {_OUT} tk",
    "rrf_fusion": f"WITH {_F}, {_top('a', 'q', 'f', 20)}, {_top('b', 'q', 'f', 20, 'q.v[1:16]', 'f.v[1:16]')}, {_RRF} SELECT query_id, point_id, round(score, 6) AS score, CASE WHEN x AND y THEN 'full,short' WHEN x THEN 'full' ELSE 'short' END AS matched_via, rank FROM fused",
    "hybrid_search": f"{_HYBRID} SELECT query_id, point_id, round(score, 6) AS score, CASE WHEN x AND y THEN 'dense,token' WHEN x THEN 'dense' ELSE 'token' END AS matched_via, rank FROM fused",
    "interactive_search": f"""{_HYBRID}, p AS (SELECT fused.*, source_file, frame_idx, scene_id FROM fused JOIN f USING (point_id)), c AS ({_COH}),
        d AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file, scene_id ORDER BY round(boosted, 9) DESC, point_id) AS n FROM c),
        e AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY round(boosted, 9) DESC, point_id)::INTEGER AS rank FROM d WHERE n = 1)
        SELECT query_id, point_id, source_file, scene_id, round(boosted, 6) AS score, rank FROM e WHERE rank <= 10""",
    "coherence_boost": f"""{_H}, {_PLACED}, c AS ({_COH})
        SELECT query_id, point_id, round(score, 6) AS score, round(boosted, 6) AS boosted, row_number() OVER (PARTITION BY query_id ORDER BY round(boosted, 9) DESC, point_id)::INTEGER AS rank FROM c""",
    "scene_diversify": f"""{_H}, {_PLACED}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file, scene_id ORDER BY score DESC, point_id) AS n FROM p),
        e AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id)::INTEGER AS rank FROM d WHERE n = 1)
        SELECT query_id, point_id, source_file, scene_id, round(score, 6) AS score, rank FROM e WHERE rank <= 10""",
    "head_tail_rerank": f"""WITH {_F}, {_top('h', 'q', 'f', 30)}, n AS (SELECT query_id, point_id, rank AS old_rank, (point_id * 7 % 13) / 13.0::DOUBLE AS s FROM h)
        SELECT query_id, point_id, old_rank, row_number() OVER (PARTITION BY query_id ORDER BY old_rank > 20, CASE WHEN old_rank > 20 THEN 0 ELSE round(s, 9) END DESC, old_rank)::INTEGER AS rank FROM n""",
    "in_video_refine": f"""WITH {_F}, {_top('t', 'q', 'f', 10)}, h AS (SELECT query_id, point_id, 1.0::DOUBLE / (60 + rank) AS score, source_file FROM t JOIN f USING (point_id)),
        b AS (SELECT query_id, source_file, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, source_file) AS n FROM h GROUP BY query_id, source_file),
        c AS (SELECT b.query_id, f.point_id, f.source_file, round(list_cosine_similarity(q.v, f.v), 9) AS cos FROM b JOIN q USING (query_id) JOIN f ON f.source_file = b.source_file WHERE b.n <= 3 AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = b.query_id AND h.point_id = f.point_id)),
        m AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY cos DESC, point_id) AS n FROM c),
        u AS (SELECT query_id, point_id, score FROM h UNION ALL SELECT query_id, point_id, cos / 61 FROM m WHERE n <= 2)
        SELECT query_id, point_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, point_id)::INTEGER AS rank FROM u""",
    "ambiguity": f"""{_H}, {_PLACED}, t AS (SELECT query_id, count(DISTINCT source_file) / count(*) AS video_ratio, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2 FROM p WHERE rank <= 10 GROUP BY query_id),
        m AS (SELECT *, CASE WHEN s1 > 0 AND s2 IS NOT NULL THEN 1 - least(greatest((s1 - s2) / s1, 0), 1) ELSE 0 END AS margin FROM t)
        SELECT query_id, round(video_ratio, 6) AS video_ratio, round(margin, 6) AS margin, round(0.5::DOUBLE * video_ratio + 0.5::DOUBLE * margin, 6) AS ambiguity, round(0.5::DOUBLE * video_ratio + 0.5::DOUBLE * margin, 9) >= 0.7 AS ask FROM m""",
    "shot_islands": f"""WITH {_S}, a AS (SELECT *, prob > 0.5 AND NOT lag(prob > 0.5) OVER (PARTITION BY source_file ORDER BY frame_idx) AS rise FROM s),
        b AS (SELECT *, sum(coalesce(rise, false)::INT) OVER (PARTITION BY source_file ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)::INTEGER AS shot FROM a)
        SELECT source_file, shot, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM b GROUP BY ALL""",
    "sharpness_scaled": f"""WITH {_S}, c AS (SELECT source_file, scene_id, quantile_cont(size, 0.1) AS lo, quantile_cont(size, 0.9) AS hi FROM z GROUP BY ALL)
        SELECT source_file, scene_id, i, round(CASE WHEN hi > lo THEN least(greatest((size - lo) / (hi - lo), 0), 1) ELSE 0.5 END, 6) AS sharpness FROM z JOIN c USING (source_file, scene_id)""",
    "speech_attach": """WITH a AS (SELECT user_id, props, floor(epoch(ts))::BIGINT::DOUBLE AS t FROM events WHERE event_type = 'view'),
        c AS (SELECT event_id AS point_id, user_id, floor(epoch(ts))::BIGINT::DOUBLE AS t FROM events WHERE event_type = 'click')
        SELECT point_id, c.user_id::VARCHAR AS source_file, coalesce(string_agg(a.props, ' ' ORDER BY a.t, a.props), '') AS speech, count(a.t) AS n_segments
        FROM c LEFT JOIN a ON a.user_id = c.user_id AND a.t - 3600 <= c.t AND c.t <= a.t + 2 + 3600 GROUP BY ALL""",
    "nearest_frame": f"""WITH {_S}, k AS (SELECT source_file, frame_idx AS native_idx, 'k' || event_id::VARCHAR AS name FROM s WHERE event_id % 7 = 0),
        j AS (SELECT s.source_file, s.frame_idx, name, abs(frame_idx - native_idx) AS d, row_number() OVER (PARTITION BY s.source_file, s.frame_idx ORDER BY abs(frame_idx - native_idx), native_idx) AS n FROM s JOIN k ON k.source_file = s.source_file AND abs(frame_idx - native_idx) <= 5)
        SELECT s.source_file, s.frame_idx, name AS keyframe, d AS distance FROM s LEFT JOIN j ON j.source_file = s.source_file AND j.frame_idx = s.frame_idx AND j.n = 1""",
    "audio_segments": """WITH d AS (SELECT user_id::VARCHAR AS source_file, round(sum(value), 2) AS duration FROM events GROUP BY user_id),
        e AS (SELECT source_file, duration, unnest(range(0, ceil(duration / 10)::BIGINT)) AS i FROM d WHERE duration > 0)
        SELECT source_file, round(i * 10.0::DOUBLE, 6) AS start, round(least((i + 1) * 10.0::DOUBLE, duration), 6) AS "end" FROM e""",
    "transcript": """WITH n AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        t AS (SELECT conv_id, turn, concat_ws(chr(10), CASE WHEN coalesce(text, '') <> '' THEN 'User: ' || text END, CASE WHEN r = 'assistant' AND coalesce(x, '') <> '' THEN 'System: ' || x END) AS t FROM n WHERE role = 'user')
        SELECT conv_id AS session_id, string_agg(t, chr(10) ORDER BY turn) AS transcript, count(*) AS n_turns FROM t WHERE t <> '' GROUP BY conv_id""",
    "grounded_answers": f"{_GROUNDED} SELECT event_id, valid, answer, round(confidence, 6) AS confidence, reason FROM r",
    "grounding_reasons": f"{_GROUNDED} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM r GROUP BY ALL",
    "score_parse": "SELECT event_id, CASE WHEN event_id % 15 <= 10 THEN round((event_id % 15) / 10.0::DOUBLE, 6) END AS score FROM events",
    "retrieval_metrics": f"""WITH {_F}, {_top('h', 'q', 'f', 21)}, o AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM h WHERE point_id <> query_id),
        m AS (SELECT o.query_id, min(o.rank) AS first FROM o JOIN q USING (query_id) JOIN f USING (point_id) WHERE f.label = q.label AND o.rank <= 20 GROUP BY o.query_id),
        r AS (SELECT ((query_id % 150) / 50 + 1)::INTEGER AS type, query_id % 100 = 0 AS annotated, first FROM q LEFT JOIN m USING (query_id))
        SELECT type, count(*) AS n, round(avg((coalesce(first, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(first, 99) <= 5)::INT), 6) AS recall_5, round(avg((coalesce(first, 99) <= 10)::INT), 6) AS recall_10,
        round(avg((coalesce(first, 99) <= 20)::INT), 6) AS recall_20, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / log2(first + 1) ELSE 0 END), 6) AS ndcg_10,
        round(avg(CASE WHEN annotated THEN coalesce(1.0::DOUBLE / first, 0) END), 6) AS mrr_annotated FROM r GROUP BY type""",
    "latency_stats": """SELECT user_id % 3 AS type, event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_cont(value, 0.5), 6) AS p50,
        round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY ALL""",
    "avs_duplicates": f"""WITH {_SUB}, d AS (SELECT *, max(correct) OVER (PARTITION BY task, video ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s)
        SELECT id, task, video FROM d WHERE seen AND id % 11 <> 0""",
    "kis_score": f"""WITH {_SUB}, w AS (SELECT *, sum((NOT correct)::INT) OVER (PARTITION BY team, task ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS wrong, row_number() OVER (PARTITION BY team, task, correct ORDER BY t, id) AS n FROM s),
        f AS (SELECT team, task, greatest(0, 50 + (300 - t) / 6 - 10 * wrong) AS score FROM w WHERE correct AND n = 1)
        SELECT k.team, k.task, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT team, task FROM s) k LEFT JOIN f USING (team, task)""",
    "avs_score": f"{_AVS} SELECT team, task, round(score, 6) AS score FROM w",
    "contest_totals": f"{_AVS}, m AS (SELECT team, score, max(score) OVER (PARTITION BY task) AS most FROM w) SELECT team, round(sum(CASE WHEN most > 0 THEN 1000 * score / most ELSE 0 END), 6) AS total FROM m GROUP BY team",
    "stable_ids": f"""WITH {_F}, k AS (SELECT point_id, source_file || ':shot:' || lpad(scene_id::VARCHAR, 6, '0') AS shot_key FROM f),
        h AS (SELECT *, substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(shot_key)), 1, 32) AS h FROM k)
        SELECT point_id, shot_key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS shot_uuid FROM h""",
    "text_quality_filter": """SELECT event_id FROM events WHERE length(trim(props)) >= 2 AND (event_id % 5 = 0 OR event_id % 10 <= 6) AND (event_id % 7 = 0 OR event_id % 20 <= 10) AND (event_id % 3 = 0 OR event_id % 30 <= 24)""",
    "collection_counts": f"WITH {_F} SELECT source_file, count(*) AS n, count(DISTINCT scene_id) AS scenes FROM f GROUP BY source_file",
    "search_text": """SELECT page_id, concat_ws(' . ', nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), nullif(regexp_extract(url, '://([^/]+)', 1), '')) AS text_blob FROM pages""",
    "tile_grid": """WITH e AS (SELECT vec_id, vec_id % 7 * 300 + 200 AS w, vec_id % 5 * 250 + 100 AS h FROM embeddings),
        x AS (SELECT vec_id, h, unnest(list_distinct(list_concat(range(0, greatest(w - 640, 0) + 1, 512), [greatest(w - 640, 0)]))) AS x FROM e)
        SELECT vec_id, x, unnest(list_distinct(list_concat(range(0, greatest(h - 640, 0) + 1, 512), [greatest(h - 640, 0)]))) AS y FROM x""",
    "feedback_lines": """WITH b AS (SELECT user_id AS session_id, (event_id % 4)::INTEGER AS turn, event_id AS place, event_id AS point_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS sign FROM events WHERE event_type IN ('purchase', 'error')),
        w AS (SELECT b.*, coalesce(CASE WHEN doc_id % 3 = 1 THEN nullif(left(trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')), 120), '') END, 'V' || doc_id::VARCHAR, point_id::VARCHAR) AS w FROM b LEFT JOIN documents d ON d.doc_id = b.point_id),
        u AS (SELECT session_id, turn, sign, w, min(place) AS place FROM w GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn, sign ORDER BY place) AS n FROM u)
        SELECT session_id, turn, sign, string_agg(w, '|' ORDER BY place) AS lines FROM r WHERE n <= 3 GROUP BY session_id, turn, sign""",
    "rocchio_search": f"""WITH {_F}, mu AS (SELECT q.query_id, s, unnest(f.v) AS x, unnest(range(1, 65)) AS d FROM q CROSS JOIN (VALUES (1, 1), (2, 1), (3, -1)) t(o, s) JOIN f ON f.point_id = q.query_id + o),
        md AS (SELECT query_id, s, d, avg(x) AS x FROM mu GROUP BY ALL), ml AS (SELECT query_id, s, list(x ORDER BY d) AS v FROM md GROUP BY ALL),
        m AS (SELECT q.query_id, list_transform(range(1, 65), lambda i: q.v[i] + 0.75::DOUBLE * coalesce(p.v[i], 0) - 0.15::DOUBLE * coalesce(n.v[i], 0)) AS v
              FROM q LEFT JOIN ml p ON p.query_id = q.query_id AND p.s = 1 LEFT JOIN ml n ON n.query_id = q.query_id AND n.s = -1), {_top('h', 'm', 'f', 10)} {_OUT} h""",
    "coarse_to_fine": f"""WITH {_F}, {_SHOTS}, s AS (SELECT sv.shot_id, sv.v, first.point_id FROM sv JOIN (SELECT source_file, scene_id, arg_min(point_id, frame_idx) AS point_id FROM f GROUP BY ALL) first USING (source_file, scene_id)),
        {_top('b', 'q', 's', 8)}, w AS (SELECT b.query_id, s.shot_id FROM b JOIN s USING (point_id)),
        c AS (SELECT w.query_id, f.point_id, round(list_cosine_similarity(q.v, f.v), 9) AS score FROM w JOIN q USING (query_id) JOIN (SELECT *, {_SHOT} AS shot_id FROM f) f USING (shot_id)),
        h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id)::INTEGER AS rank FROM c) {_OUT} h WHERE rank <= 10""",
    "shot_vectors": f"""WITH {_F}, {_SHOTS}, t AS (SELECT f.*, text FROM f LEFT JOIN documents ON doc_id = point_id),
        c AS (SELECT {_SHOT} AS shot_id, count(*)::INTEGER AS frame_count, string_agg(point_id::VARCHAR, ',' ORDER BY frame_idx) AS frame_ids, count(timestamp)::INTEGER AS n_times,
              md5(left(coalesce(string_agg(nullif(text, ''), ' . ' ORDER BY frame_idx), ''), 8000)) AS text_md5 FROM t GROUP BY source_file, scene_id)
        SELECT c.*, unnest(range(0, 64))::INTEGER AS component, unnest(list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6))) AS x FROM c JOIN sv USING (shot_id)""",
    "boundary_similarity": f"""WITH {_F}, {_UNIT}, w AS (SELECT *, CASE WHEN n > 1 THEN (list_inner_product(s, s) - n) / (n * (n - 1)) ELSE 1.0::DOUBLE END AS within FROM ul),
        b AS (SELECT *, lead(scene_id) OVER o AS next_scene, lead(s) OVER o AS s2, lead(n) OVER o AS n2, lead(within) OVER o AS next_within FROM w WINDOW o AS (PARTITION BY source_file ORDER BY scene_id)),
        c AS (SELECT *, list_inner_product(s, s2) / (n * n2) AS cross, (within + next_within) / 2 AS mean FROM b WHERE next_scene IS NOT NULL)
        SELECT source_file, scene_id, next_scene, round(within, 6) AS within, round(next_within, 6) AS next_within, round("cross", 6) AS "cross", mean > 0 AND round("cross" / mean, 9) >= 0.9 AS weak FROM c""",
    "temporal_chain": f"""WITH {_F}, {_EVENTS}, {_step(0)}, {_step(1)}, {_step(2)}, c0 AS (SELECT query_id, source_file, frame_idx, score AS total, [frame_idx] AS path FROM h0), {_chained(1)}, {_chained(2)},
        b AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY round(total, 9) DESC, frame_idx) AS n FROM c2)
        SELECT query_id, source_file, round(total, 6) AS score, array_to_string(path, ',') AS frames, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, source_file)::INTEGER AS rank FROM b WHERE n = 1""",
    "event_alignment": f"""WITH {_F}, {_EVENTS}, s AS (SELECT query_id, source_file, frame_idx, point_id, list(round(list_cosine_similarity(ev.v, f.v), 9) ORDER BY event) AS sims FROM ev CROSS JOIN f GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY frame_idx, point_id) AS j FROM s),
        d0 AS (SELECT *, {{'total': sims[1], 'j': j, 'path': [frame_idx]}} AS d FROM r), {_aligned(1)}, {_aligned(2)}, o AS (SELECT query_id, source_file, max(d) AS d FROM d2 WHERE d IS NOT NULL GROUP BY ALL)
        SELECT query_id, source_file, round(d.total / 3, 6) AS score, array_to_string(d.path, ',') AS frames FROM o""",
    "clarification_boost": f"""WITH {_T}, a AS (SELECT doc_id - 1 AS query_id, list_filter({_TOK.format("text")}, lambda w: NOT list_contains({_STOPS}, w)) AS a FROM documents WHERE doc_id % 100 = 1),
        o AS (SELECT tk.query_id, tk.point_id, tk.score, tk.rank AS old_rank, CASE WHEN tk.point_id % 2 = 0 AND len(a) > 0 THEN len(list_intersect(a, tx.t)) / len(a) ELSE 0.0::DOUBLE END AS share, max(tk.score) OVER (PARTITION BY tk.query_id) AS top
              FROM tk JOIN tx USING (point_id) LEFT JOIN a ON a.query_id = tk.query_id),
        b AS (SELECT *, score + 0.5::DOUBLE * share * top AS boosted FROM o)
        SELECT query_id, point_id, round(round(share, 3), 6) AS overlap, round(boosted, 6) AS boosted, row_number() OVER (PARTITION BY query_id ORDER BY round(boosted, 9) DESC, old_rank)::INTEGER AS rank FROM b""",
    "dake_keep": f"""WITH {_S}, m AS (SELECT *, max(size) OVER (PARTITION BY source_file, scene_id) AS most FROM z),
        d AS (SELECT *, {" + ".join(_STEEP(f, g) for g in (1, 2, 3) for f in ("lag", "lead"))} AS dake FROM m WINDOW w AS (PARTITION BY source_file, scene_id ORDER BY i)),
        t AS (SELECT *, count(*) OVER s AS n, row_number() OVER (PARTITION BY source_file, scene_id ORDER BY round(dake, 9) DESC, i) <= round_even((count(*) OVER s) * 0.5::DOUBLE, 0) AS top, row_number() OVER w - 1 AS pos FROM d WINDOW s AS (PARTITION BY source_file, scene_id), w AS (PARTITION BY source_file, scene_id ORDER BY i)),
        k AS (SELECT *, coalesce(max(CASE WHEN top THEN pos END) OVER (PARTITION BY source_file, scene_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last FROM t)
        SELECT source_file, scene_id, i, round(dake, 6) AS dake FROM k WHERE n <= 2 OR top OR (pos - last) % 4 = 0""",
    "motion_sample": f"""WITH {_S}, a AS (SELECT source_file, scene_id, i, greatest(size, 0) AS e, lead(i) OVER w AS nxt, count(*) OVER s AS size, least(16, greatest(4, round_even((max(i) OVER s - min(i) OVER s) / 4.0::DOUBLE * 2.5, 0)))::INTEGER AS n FROM z
            WINDOW w AS (PARTITION BY source_file, scene_id ORDER BY i), s AS (PARTITION BY source_file, scene_id)),
        b AS (SELECT *, avg(CASE WHEN nxt IS NOT NULL THEN e END) OVER (PARTITION BY source_file, scene_id) AS mean FROM a),
        c AS (SELECT *, CASE WHEN nxt IS NULL THEN 0.0::DOUBLE ELSE greatest(e + CASE WHEN mean > 0 THEN 0.05::DOUBLE * mean ELSE 1 END, 1e-8) END AS m FROM b),
        d AS (SELECT *, sum(m) OVER (PARTITION BY source_file, scene_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, sum(m) OVER (PARTITION BY source_file, scene_id) AS total FROM c),
        q AS (SELECT *, round(upto / total, 9) AS hi, round((upto - m) / total, 9) AS lo, unnest(range(0, n)) AS k FROM d WHERE size > n AND nxt IS NOT NULL),
        p AS (SELECT *, round((k + 0.5::DOUBLE) / n, 9) AS q FROM q)
        SELECT source_file, scene_id, i FROM d WHERE size <= n UNION ALL
        SELECT DISTINCT source_file, scene_id, CASE WHEN round(least(greatest((q - lo) / greatest(hi - lo, 1e-8), 0), 1), 9) <= 0.5 THEN i ELSE nxt END AS i FROM p WHERE q > lo AND q <= hi""",
    "box_nms": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings), l AS (SELECT *, list_min(v) AS lo, list_max(v) AS hi FROM e),
        s AS (SELECT vec_id, v, list_transform(v, lambda x: CASE WHEN hi > lo THEN round((x - lo) / (hi - lo) * 100, 3) ELSE 0 END) AS c FROM l),
        d AS (SELECT vec_id, list_transform(list_sort([{", ".join(_box(k) for k in range(8))}]), lambda x: [x]) AS d FROM s),
        n AS (SELECT vec_id, list_reduce(d, lambda kept, b: CASE WHEN len(list_filter(kept, lambda o: o.label = b[1].label AND {_AREAS} - {_INTER} > 0 AND {_INTER} / ({_AREAS} - {_INTER}) >= 0.3)) > 0 THEN kept ELSE list_concat(kept, b) END) AS kept FROM d),
        u AS (SELECT vec_id, unnest(range(0, len(kept)))::INTEGER AS place, unnest(kept) AS b FROM n) SELECT vec_id, place, b.label AS label, round(b.conf, 6) AS conf FROM u""",
    "token_sizing": """WITH e AS (SELECT event_id, event_id % 1900 + 20 AS h, event_id * 7 % 2500 + 30 AS w FROM events),
        a AS (SELECT *, greatest(28, round_even(h / 28.0::DOUBLE, 0) * 28) AS h0, greatest(28, round_even(w / 28.0::DOUBLE, 0) * 28) AS w0, sqrt((h * w) / 1003520.0::DOUBLE) AS down, sqrt(3136.0::DOUBLE / (h * w)) AS up FROM e),
        b AS (SELECT *, CASE WHEN h0 * w0 > 1003520 THEN greatest(28, floor(h / down / 28) * 28) WHEN h0 * w0 < 3136 THEN ceil(h * up / 28) * 28 ELSE h0 END AS hh,
              CASE WHEN h0 * w0 > 1003520 THEN greatest(28, floor(w / down / 28) * 28) WHEN h0 * w0 < 3136 THEN ceil(w * up / 28) * 28 ELSE w0 END AS ww FROM a)
        SELECT event_id, CASE WHEN greatest(h, w) / least(h, w) <= 200 THEN hh::BIGINT END AS h, CASE WHEN greatest(h, w) / least(h, w) <= 200 THEN ww::BIGINT END AS w, CASE WHEN greatest(h, w) / least(h, w) <= 200 THEN (hh * ww / 784)::BIGINT END AS tokens FROM b""",
    "batch_search": f"{_BATCH} SELECT query_id, type, rank, answer FROM results",
    "batch_results": f"""{_BATCH} SELECT ask.query_id, ask.type, coalesce(arg_min(r.answer, r.rank), 'N/A') AS result, count(r.answer)::INTEGER AS n FROM ask LEFT JOIN results r USING (query_id) GROUP BY ask.query_id, ask.type""",
    "evaluation_replay": f"""{_BATCH}, truth AS (SELECT a.query_id, a.type, f.source_file, f.frame_idx FROM ask a JOIN f ON f.point_id = a.query_id),
        spot AS (SELECT e.query_id, list(f.frame_idx) AS spots FROM ev e JOIN f ON f.point_id = e.query_id + e.event GROUP BY e.query_id),
        m AS (SELECT r.query_id, min(r.rank) AS first FROM results r JOIN truth t USING (query_id) WHERE r.source_file = t.source_file AND (r.type = 3 OR abs(r.frame_idx - t.frame_idx) <= 5) GROUP BY r.query_id),
        sr AS (SELECT m.query_id, len(list_filter(s.spots, lambda x: len(list_filter(r.path, lambda y: abs(x - y) <= 5)) > 0)) / len(s.spots) AS recall FROM m JOIN results r ON r.query_id = m.query_id AND r.rank = m.first JOIN spot s ON s.query_id = m.query_id WHERE r.type = 3),
        a AS (SELECT ask.type, t.query_id IS NOT NULL AS known, m.first, sr.recall FROM ask LEFT JOIN truth t USING (query_id) LEFT JOIN m USING (query_id) LEFT JOIN sr USING (query_id))
        SELECT type, count(*) AS n, round(avg((coalesce(first, 999) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(first, 999) <= 5)::INT), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr,
        round(avg(CASE WHEN known THEN coalesce(1.0::DOUBLE / first, 0) END), 6) AS mrr_annotated, round(avg(recall), 6) AS sequence_recall, CASE WHEN count(recall) > 0 THEN 1.0::DOUBLE END AS in_order FROM a GROUP BY type""",
    "interactive_session": f"""WITH {_F}, {_ASK}, {_retrieved('r', 15)}, p AS (SELECT * FROM r), c AS (SELECT * RENAME (score AS plain) FROM ({_COH})), {_scenes('s', 'c', 'boosted', 100)},
        pv AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) AS n FROM r), pr AS (SELECT query_id + 50 AS query_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM pv WHERE n = 1) WHERE place <= 5),
        aw AS (SELECT query_id, list_filter({_TOK.format("text")}, lambda w: NOT list_contains({_STOPS}, w)) AS a FROM ask WHERE query_id IN (SELECT query_id FROM pr)),
        ob AS (SELECT s.*, boosted + 0.5::DOUBLE * CASE WHEN pr.point_id IS NOT NULL AND len(a) > 0 THEN len(list_intersect(a, t)) / len(a) ELSE 0 END * max(boosted) OVER (PARTITION BY s.query_id) AS high FROM s LEFT JOIN pr USING (query_id, point_id) LEFT JOIN aw ON aw.query_id = s.query_id WHERE s.query_id % 150 = 0),
        oo AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY round(high, 9) DESC, rank)::INTEGER AS rank FROM ob),
        hh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(high, 9) DESC, point_id) AS n FROM oo),
        amb AS (SELECT query_id, count(DISTINCT source_file) / count(*) AS ratio, max(CASE WHEN n = 1 THEN high END) AS s1, max(CASE WHEN n = 2 THEN high END) AS s2 FROM hh WHERE n <= 10 GROUP BY query_id),
        asks AS (SELECT query_id, round(0.5::DOUBLE * ratio + 0.5::DOUBLE * CASE WHEN s1 > 0 AND s2 IS NOT NULL THEN 1 - least(greatest((s1 - s2) / s1, 0), 1) ELSE 0 END, 9) >= 0.7 AS ask FROM amb),
        o1 AS (SELECT *, coalesce({_SAID}, 0) AS final FROM oo WHERE rank <= 10),
        t2 AS (SELECT * EXCLUDE (boosted), boosted AS score FROM s WHERE query_id % 150 = 50 AND rank <= 10), {_answers('t2')}, s3 AS (SELECT *, boosted AS score FROM s WHERE rank <= 20), {_sequenced('s3')}
        SELECT query_id, 1 AS type, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, o1.rank)::INTEGER AS rank, point_id::VARCHAR AS item, round(final, 6) AS score, via AS matched_via, ask FROM o1 JOIN asks USING (query_id) WHERE final >= 0.2
        UNION ALL SELECT query_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, vqa.rank)::INTEGER, point_id::VARCHAR, round(final, 6), via, false FROM vqa
        UNION ALL SELECT query_id, 3, rank, source_file, round(score, 6), '', false FROM seq""",
}
