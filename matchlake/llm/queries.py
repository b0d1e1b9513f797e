"""One query per operator over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import backoff_scores, centroids, decontaminate, divergence, neighbours, license_scan, line_dedup, near_dedup, pieces, preference, quality, token_shards, url_filter
from matchlake.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_shards.new_folder(spark)
    token_shards.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_shards.read(spark, folder).withColumnRenamed("doc", "doc_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.swapped_answers(table(spark, sf_dir, "conversations"))
    rows = preference.format_pairs(pairs)
    sides = []
    for side in ("chosen", "rejected"):
        trained = preference.trained_text(F.col(f"{side}_pieces"))
        sides += [
            F.sha2(f"{side}_completion", 256).alias(f"{side}_sha256"),
            F.sha2(trained, 256).alias(f"{side}_trained_sha256"),
            F.length(trained).cast("long").alias(f"{side}_trained_chars"),
        ]
    return rows.select(
        F.col("pair_id").alias("conv_id"),
        F.col("n_prefix").cast("long").alias("n_prefix"),
        F.sha2("prompt", 256).alias("prompt_sha256"),
        *sides,
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds what is also fetched through a feed: canonical URLs of pages tagged ``utm_source=feed``."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("url").contains("utm_source=feed")).select(url_filter.canonical(F.col("url")).alias("url"))
    return url_filter.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


def op9_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff_scores.score(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.keep_bitmaps(table(spark, sf_dir, "documents"))
    kept = line_dedup.kept_text(F.col("text"), F.col("n_dropped"), F.col("keep_runs"))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_quality, op2_near_dedup, op3_token_shards, op4_license_scan, op5_preference,
    op6_decontaminate, op7_pieces, op8_url_filter, op9_backoff_scores, op10_line_dedup,
    op11_divergence, op12_centroids, op13_neighbours,
)}

# Words of a text: A-Z lower-cased, then runs of digits, a to z and everything beyond ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LLM_SQL = {
    "op2_near_dedup": r"""
        WITH RECURSIVE word AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        shingle AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s
            FROM word WHERE len(w) > 0),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (
            SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
            WHERE 100 * c >= 85 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
        root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents JOIN root USING (doc_id) LEFT JOIN size USING (doc_id)""",
    "op6_decontaminate": f"""
        WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        gram AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n,
                   unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: list_slice(w, i, i + least(len(w), 10) - 1))) AS g
            FROM item WHERE len(w) > 0),
        doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM gram),
        place AS (
            SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'g': list_slice(w, i, i + n - 1)}})) AS p
            FROM doc, sizes WHERE len(w) >= n),
        hit AS (SELECT doc_id, p.i AS i, gram.n AS n, item_id FROM place JOIN gram ON p.g = gram.g AND place.n = gram.n),
        word AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit),
        words AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_preference": """
        WITH conv AS (
            SELECT conv_id, a[:coalesce(list_max(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i].role = 'assistant' THEN i END)), len(a))] AS a
            FROM (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS a
                  FROM conversations GROUP BY conv_id)),
        pair AS (
            SELECT x.conv_id, x.a,
                   CASE WHEN y.conv_id IS NULL THEN x.a[:-2]
                        ELSE list_append(x.a[:-2], {'turn': x.a[-1].turn, 'role': x.a[-1].role, 'text': y.a[-1].text}) END AS b
            FROM conv x LEFT JOIN conv y ON y.conv_id = x.conv_id + 1),
        prefix AS (
            SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i:
                       a[i].role IS DISTINCT FROM b[i].role OR a[i].text IS DISTINCT FROM b[i].text)) - 1, least(len(a), len(b))) AS n
            FROM pair),
        side AS (
            SELECT conv_id, n,
                   list_transform(a[1:n], lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)) AS p,
                   a[n + 1:] AS c, b[n + 1:] AS r
            FROM prefix),
        text AS (
            SELECT conv_id, n, array_to_string(p, '') AS prompt,
                   array_to_string(list_transform(c, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), '') AS c,
                   array_to_string(list_transform(r, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), '') AS r,
                   array_to_string(list_transform(list_filter(c, lambda t: t.role = 'assistant'), lambda t: coalesce(t.text, '') || '<|end|>' || chr(10)), '') AS ct,
                   array_to_string(list_transform(list_filter(r, lambda t: t.role = 'assistant'), lambda t: coalesce(t.text, '') || '<|end|>' || chr(10)), '') AS rt
            FROM side)
        SELECT conv_id, n AS n_prefix, sha256(prompt) AS prompt_sha256,
               sha256(c) AS chosen_sha256, sha256(ct) AS chosen_trained_sha256, length(ct) AS chosen_trained_chars,
               sha256(r) AS rejected_sha256, sha256(rt) AS rejected_trained_sha256, length(rt) AS rejected_trained_chars
        FROM text""",
    "op8_url_filter": r"""
        WITH part AS (
            SELECT page_id, url,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        page AS (
            SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '') END AS canonical
            FROM part),
        rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        best AS (
            SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
            FROM page JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
        listed AS (SELECT DISTINCT canonical FROM page WHERE contains(url, 'utm_source=feed') AND canonical IS NOT NULL)
        SELECT page_id, host, path, rule,
               coalesce(verdict, CASE WHEN listed.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
               listed.canonical IS NOT NULL AS listed
        FROM page LEFT JOIN best USING (page_id) LEFT JOIN listed ON listed.canonical = page.canonical""",
    "op10_line_dedup": r"""
        WITH line AS (
            SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
        keyed AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM line),
        common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}


def _centroid_sql(k: int = 16, dim: int = 64, rounds: int = 3) -> str:
    """Lloyd's rounds unrolled: components as rows, distances by a join on the component number."""
    parts = [
        f"""pts AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = {dim}
              AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x) AND abs(floor(64 * CAST(x AS DOUBLE))) < 134217728, false))))""",
        "comp AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM pts)",
        f"""c0 AS (
            SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS INTEGER) AS k, v FROM pts
            QUALIFY row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) <= {k})""",
    ]
    for r in range(rounds + 1):
        parts += [
            f"cc{r} AS (SELECT k, unnest(range(len(v))) AS i, unnest(v) AS y FROM c{r})",
            f"d{r} AS (SELECT vec_id, k, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM comp JOIN cc{r} USING (i) GROUP BY vec_id, k)",
            f"a{r} AS (SELECT vec_id, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)",
        ]
        if r < rounds:
            parts += [
                f"s{r} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN comp USING (vec_id) GROUP BY k, i)",
                f"n{r} AS (SELECT k, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY k)",
                f"c{r + 1} AS (SELECT c{r}.k, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} ON n{r}.k = c{r}.k)",
            ]
    last = rounds
    return "WITH " + ",\n        ".join(parts) + f"""
        SELECT vec_id, k AS cluster, d AS distance,
               CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
        FROM a{last} JOIN c{last} USING (k)"""


LLM_SQL["op12_centroids"] = _centroid_sql()

LLM_SQL["op11_divergence"] = r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents),
    tok AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    tg AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT r) AS df FROM tok GROUP BY ALL),
    kept AS (SELECT lang, term, sum(c) AS cl FROM tg GROUP BY lang, term HAVING sum(df) >= 30),
    lv AS (SELECT lang, count(*) AS v, sum(cl) AS nl FROM kept GROUP BY lang),
    grp AS (SELECT DISTINCT lang, source FROM d),
    gn AS (SELECT lang, source, sum(c) AS n FROM tg JOIN kept USING (lang, term) GROUP BY ALL),
    con AS (
        SELECT lang, source, coalesce(v, 0) AS v, CAST(coalesce(n, 0) + 5 * coalesce(v, 0) AS BIGINT) AS den,
               CAST(coalesce(nl, 0) + 5 * coalesce(v, 0) AS BIGINT) AS denl
        FROM grp LEFT JOIN lv USING (lang) LEFT JOIN gn USING (lang, source)),
    everything AS (
        SELECT con.lang, con.source, kept.term, CAST(coalesce(tg.c, 0) AS BIGINT) AS c, CAST(kept.cl AS BIGINT) AS cl, con.den, con.denl
        FROM con JOIN kept ON kept.lang = con.lang LEFT JOIN tg ON tg.lang = con.lang AND tg.source = con.source AND tg.term = kept.term),
    pv AS (
        SELECT lang, source, term, c, 1 + (CAST(1000000000 AS BIGINT) * (c + 5)) // den AS p,
               1 + (CAST(1000000000 AS BIGINT) * (cl + 5)) // denl AS q
        FROM everything),
    pair AS (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM pv a JOIN pv b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
        SELECT x.lang, x.source, y.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
        FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source),
    terms AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM pv WHERE c > 0 AND p > q),
    ranked AS (
        SELECT lang, source, 'pair' AS part, item, value,
               CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
        UNION ALL
        SELECT lang, source, 'term' AS part, item, value,
               CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""
