"""A query for each operator over the whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm import decontam, divergence, forest, jaccard, lines, lm, maxscore, mixing, quality, toxicity, urls, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """keep and __score of each document; learns from labels whose remainder isn't 0."""
    learn = labels.filter(quality.remainder("doc_id", 5) != 0)
    known = learn.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    model = quality.train(texts, known)
    return quality.score(docs.select(*keep, F.col("text").cast("string").alias("__text")), model, "__text", "__score")


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = maxscore.quantised(_table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(rows, rows.filter("id % 50 = 0"), 5).withColumnRenamed("id", "vec_id")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"])
    predicted = (F.col("__score") >= 0.3).cast("int")
    return scored.select("doc_id", (quality.remainder("doc_id", 5) == 0).alias("held_out"), F.col("__score").alias("score"), predicted.alias("predicted"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories: toxic and of good quality; toxic and of bad quality; toxic at all, which sees the other two.  Learns from rows that op4 learns from too."""
    labels = _table(spark, sf_dir, "labels").filter(quality.remainder("doc_id", 5) != 0)
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    kinds = labels.select(F.col("doc_id").cast("long").alias("id"), toxic.cast("int").alias("toxic"), (toxic & good).cast("int").alias("toxic_prose"), (toxic & ~good).cast("int").alias("toxic_junk"))
    names = ["toxic_prose", "toxic_junk", "toxic"]
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    scored = toxicity.score(docs, toxicity.train(docs, kinds, names), names)
    return scored.select(F.col("id").alias("doc_id"), *[f"p_{x}" for x in names], (F.col("p_toxic") >= 0.4).cast("int").alias("toxic"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.array_join(F.transform("removed_lines", lambda n: n.cast("string")), ",")
    return lines.report(_table(spark, sf_dir, "documents")).withColumn("removed_lines", numbers)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
    fits = F.col("deviation") <= (1 << 63) - 1
    return out.withColumn("deviation", F.when(fits, F.col("deviation").cast("long")).otherwise(F.raise_error(F.lit("a deviation doesn't fit a long")).cast("long")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.neighbours(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    x.__name__: x
    for x in (op1_maxscore, op2_jaccard_join, op3_lm_scoring, op4_quality_classifier, op5_url_filter, op6_toxicity, op7_decontamination, op8_line_dedup, op9_mixing, op10_warc, op11_embedding_whitening, op12_source_divergence, op13_nearest_neighbours, pipeline)
}

_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+')"

SQL: dict[str, str] = {
    "op2_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 5
                THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END AS s FROM w),
        c AS (SELECT doc_id, s, CASE WHEN s IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(s, '|'))) END AS class_id FROM s),
        r AS (SELECT class_id, s, len(s) AS n FROM c WHERE doc_id = class_id AND s IS NOT NULL),
        t AS (SELECT class_id, n, unnest(s) AS g FROM r),
        p AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS an, b.n AS bn, count(*) AS o
              FROM t a JOIN t b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY ALL),
        l AS (SELECT a, b FROM p WHERE o >= 0.8 * (an + bn - o) - 1e-9),
        reach AS (SELECT a, a AS b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
        g AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
        k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT doc_id, class_id, coalesce(k.n, 0) AS n_links, coalesce(g.root, class_id) AS group_id
        FROM c LEFT JOIN k ON k.a = class_id LEFT JOIN g ON g.a = class_id""",
    "op9_mixing": """
        WITH s AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM documents GROUP BY source),
        r AS (SELECT source, CASE WHEN chars > 0 THEN sqrt(chars) / (SELECT sum(sqrt(chars)) FROM s) * (SELECT sum(chars) FROM s) / chars ELSE 1 END AS rate FROM s),
        k AS (SELECT source, rate, unnest(range(0, 200)) AS k FROM r),
        c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
        d AS (SELECT doc_id, source, ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
        n AS (SELECT doc_id, d.source, count(*) FILTER (WHERE cdf <= u) AS n FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY doc_id, d.source)
        SELECT doc_id, source, x::INTEGER AS copy, n::INTEGER AS n_copies, md5('17:' || doc_id::VARCHAR || ':' || x::VARCHAR) AS shuffle_key
        FROM (SELECT *, unnest(range(1, n + 1)) AS x FROM n)""",
    "op1_maxscore": """
        WITH v AS (SELECT vec_id AS id, max(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
             WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false) GROUP BY vec_id),
        s AS (SELECT q.id AS query_id, r.id AS vec_id, list_inner_product(q.v, r.v)::BIGINT AS score FROM v q JOIN v r ON q.id <> r.id WHERE q.id % 50 = 0),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5""",
    "op5_url_filter": """
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT *, '.' || host AS dotted FROM p),
        f AS (SELECT *, CASE WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                             WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                             WHEN ends_with(dotted, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                             WHEN ends_with(dotted, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
                             WHEN ends_with(dotted, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM r)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f""",
    "op10_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p),
        k AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM last AS again FROM l)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM k""",
    "op8_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10)))))::INTEGER AS n FROM documents WHERE doc_id IS NOT NULL),
        w AS (SELECT doc_id, n, list_sort(list_distinct({_WORDS.format("line")})) AS s FROM l),
        k AS (SELECT doc_id, n, s, md5(array_to_string(s, ' ')) AS id FROM w WHERE len(s) > 0),
        u AS (SELECT id, any_value(s) AS s, len(any_value(s)) AS size, min({{'doc': doc_id, 'n': n}}) AS first FROM k GROUP BY id),
        e AS (SELECT id, size, unnest(s) AS word FROM u), d AS (SELECT word, count(*) AS c FROM e GROUP BY word),
        o AS (SELECT id, size, word, row_number() OVER (PARTITION BY id ORDER BY c, word) AS pos FROM e JOIN d USING (word)),
        p AS (SELECT * FROM o WHERE pos <= size - ceil(0.8 * size - 1e-9) + 1),
        m AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND a.id <> b.id AND a.size >= 0.8 * b.size - 1e-9 AND b.size >= 0.8 * a.size - 1e-9),
        late AS (SELECT DISTINCT x.id FROM m JOIN u x ON x.id = m.a JOIN u y ON y.id = m.b WHERE y.first < x.first AND len(list_intersect(x.s, y.s)) >= 0.8 * (x.size + y.size - len(list_intersect(x.s, y.s))) - 1e-9),
        g AS (SELECT k.doc_id, k.n FROM k JOIN u USING (id) WHERE k.id IN (SELECT id FROM late) OR {{'doc': k.doc_id, 'n': k.n}} > u.first),
        r AS (SELECT doc_id, list(DISTINCT n ORDER BY n) AS removed FROM g GROUP BY doc_id)
        SELECT t.doc_id, t.n_lines, coalesce(len(r.removed), 0)::INTEGER AS n_removed, coalesce(array_to_string(r.removed, ','), '') AS removed_lines
        FROM (SELECT doc_id, max(len(string_split(coalesce(text, ''), chr(10))))::INTEGER AS n_lines FROM documents GROUP BY doc_id) t LEFT JOIN r USING (doc_id)""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        w AS (SELECT lang, source, row_number() OVER () AS id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM d),
        e AS (SELECT lang, source, id, unnest(ws) AS term FROM w),
        k AS (SELECT lang, term, count(*) AS lc FROM e GROUP BY ALL HAVING count(DISTINCT id) >= 30),
        c AS (SELECT lang, source, term, count(*) AS c FROM e JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        l AS (SELECT lang, count(*) AS v, sum(lc) AS n FROM k GROUP BY lang),
        gn AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        f AS (SELECT gn.lang, gn.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 5)) // (gn.n + 5 * l.v) AS p, 1 + (1000000000 * (k.lc + 5)) // (l.n + 5 * l.v) AS q
              FROM gn JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
        x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE c > 0 AND p > q),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 50""",
}
