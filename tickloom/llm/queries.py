"""One query for each corpus operator, over whole tables, and the SQL where it can be said so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .curriculum import SHAPES, curriculum, in_training_order
from .decontaminate import contaminated, find_benchmark
from .embeddings import near_duplicates as near_vectors
from .exact_dedup import exact_groups
from .language_id import held_out, identify_language, train
from .lexical_search import ranked_search
from .simhash import grouped, with_fingerprint
from .substring_dedup import remove_repeats
from .suffix_index import remove_long_repeats
from .token_counts import count_tokens, read_vocabulary
from .toxicity import fit, labelled_sample, score_toxicity
from .url_filter import url_filter
from .whitening import whitened

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    order = F.md5(F.concat_ws("|", "doc_id", "source", "text").cast("binary"))
    mixed = in_training_order(curriculum(docs, order=order))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("first_position", 6).alias("first_position"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_long_repeats(docs, keep_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), "kept_sha256", "n_repeated")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    fold = F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False))
    scored = score_toxicity(docs, fit(*labelled_sample(docs, labels.where(~fold))))
    return scored.select("doc_id", fold.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = saved(with_fingerprint(docs).select("doc_id", "fingerprint"))
    return grouped(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "/opt/tokenizers/word_bpe_49k.json") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, read_vocabulary(vocabulary)).select("doc_id", "n_words", "n_tokens")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False))
    samples = train(docs.where(~fold))
    found = identify_language(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_curriculum_mix": op2_curriculum_mix,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_index": op4_suffix_index,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}



def _position_sql(share: str, knots: tuple[tuple[float, float], ...]) -> str:
    """SQL for the time at which a schedule's integral reaches a share of its total."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    out, done = "CASE", 0.0
    for (a, b), own in zip(zip(knots, knots[1:], strict=False), area, strict=True):
        need, slope = f"({share} * {sum(area)!r}::DOUBLE - {done!r}::DOUBLE)", (b[1] - a[1]) / (b[0] - a[0])
        done += own
        out += f" WHEN {share} <= {done / sum(area)!r}::DOUBLE THEN {a[0]} + 2 * {need} / ({a[1]} + sqrt(greatest(0.0::DOUBLE, {a[1] ** 2!r}::DOUBLE + {2 * slope!r}::DOUBLE * {need})))"
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {out} ELSE 1.0 END))"


ORACLES = {
    "op2_curriculum_mix": rf"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws('|', doc_id, source, text)) AS h FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal FROM d GROUP BY source
        ), w AS (
            SELECT *, CASE ordinal % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s
        ), f AS (
            SELECT *, most / weight AS fills_at,
                   (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
            FROM w WINDOW o AS (ORDER BY most / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT source, source_size, ordinal, coalesce(least((SELECT arg_min(level, (fills_at, ordinal)) FROM f WHERE level <= fills_at) * weight, most), most) AS target FROM f
        ), q AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, t.ordinal, round(t.target)::BIGINT AS total,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), p AS (
            SELECT *, list_filter(list_transform([0, 1, 2], lambda k: before + source_size * k), lambda b: least(size, total - b) > 0) AS begins FROM q
        ), b AS (
            SELECT *, begins[1]::DOUBLE / total AS x, list_sum(list_transform(begins, lambda b: least(size, total - b))) AS words FROM p
        )
        SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(words, 0)::BIGINT AS taken,
               CASE WHEN len(begins) > 0 THEN round(CASE ordinal % 3 WHEN 0 THEN {_position_sql("x", SHAPES[0])} WHEN 1 THEN {_position_sql("x", SHAPES[1])} ELSE {_position_sql("x", SHAPES[2])} END, 6) + 0.0 END AS first_position
        FROM b
    """,
    "op1_embedding_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach(u, r) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.r
        )
        SELECT vec_id, coalesce((SELECT count(*) FROM links WHERE u = vec_id), 0) AS n_links,
               coalesce((SELECT min(r) FROM reach WHERE u = vec_id), vec_id) AS component_id,
               coalesce((SELECT min(r) FROM reach WHERE u = vec_id), vec_id) = vec_id AS kept
        FROM embeddings
    """,
    "op4_suffix_index": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
        w AS (
            SELECT r, size, i, md5_number(x[i + 1 : i + size]) AS h
            FROM (SELECT r, x, size, unnest(range(0, octet_length(x) - size + 1)) AS i FROM d, (VALUES (400), (250)) v(size) WHERE octet_length(x) >= size)
        ), again AS (SELECT r, size, i FROM w WHERE (size, h) IN (SELECT (size, h) FROM w GROUP BY size, h HAVING count(*) > 1)),
        islands AS (
            SELECT r, size, i, sum(CASE WHEN i <= before + size THEN 0 ELSE 1 END) OVER (PARTITION BY r, size ORDER BY i) AS k
            FROM (SELECT *, lag(i) OVER (PARTITION BY r, size ORDER BY i) AS before FROM again)
        ), spans AS (SELECT r, size, min(i) AS a, max(i) + size AS b FROM islands GROUP BY r, size, k),
        sums AS (
            SELECT r, sum(b - a) FILTER (WHERE size = 400) AS n_removed, count(*) FILTER (WHERE size = 400) AS n_spans, sum(b - a) FILTER (WHERE size = 250) AS n_repeated
            FROM spans GROUP BY r
        ), gaps AS (
            SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans WHERE size = 400
            UNION ALL SELECT r, max(b), NULL FROM spans WHERE size = 400 GROUP BY r
        ), kept AS (SELECT r, string_agg(hex(x[a + 1 : coalesce(b, octet_length(x))]), '' ORDER BY a) AS kept FROM gaps JOIN d USING (r) GROUP BY r)
        SELECT doc_id, octet_length(x) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(coalesce(unhex(kept), x)) AS kept_sha256, coalesce(n_repeated, 0)::BIGINT AS n_repeated
        FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
    """,
    "op7_token_counts": r"""
        WITH RECURSIVE bytes AS (
            SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 AS own FROM range(256) t(b)
        ), spelt AS (
            SELECT upper(printf('%02x', b)) AS hex, chr((CASE WHEN own THEN b ELSE 255 + count(*) FILTER (WHERE NOT own) OVER (ORDER BY b) END)::INTEGER) AS symbol FROM bytes
        ), pieces AS (
            SELECT CASE WHEN ends_with(p, '</w>') THEN left(p, len(p) - 4) ELSE p END AS piece, ends_with(p, '</w>') AS is_end
            FROM (SELECT unnest(json_keys(content, '$.model.vocab')) AS p FROM read_text('/opt/tokenizers/word_bpe_49k.json'))
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents
        ), used AS (SELECT r, unnest(ws) AS word FROM d),
        words AS (
            SELECT word, string_agg(symbol, '' ORDER BY k) AS s FROM (
                SELECT word, k, substr(h, 2 * k + 1, 2) AS hex FROM (SELECT word, hex(encode(word)) AS h, unnest(range(0, octet_length(encode(word)))) AS k FROM (SELECT DISTINCT word FROM used))
            ) JOIN spelt USING (hex) GROUP BY word
        ), longest AS (SELECT max(len(piece)) AS n FROM pieces),
        best AS (
            SELECT word, pos, max(size) AS size FROM (
                SELECT word, s, pos, unnest(range(1, least(len(s) - pos + 1, (SELECT n FROM longest)) + 1)) AS size FROM (SELECT word, s, unnest(range(1, len(s) + 1)) AS pos FROM words)
            ) JOIN pieces ON piece = substr(s, pos, size) AND is_end = (pos + size > len(s)) GROUP BY word, pos
        ), walk(word, pos, n) AS (
            SELECT word, 1::BIGINT, 0::BIGINT FROM words UNION ALL SELECT walk.word, walk.pos + size, n + 1 FROM walk JOIN best ON best.word = walk.word AND best.pos = walk.pos
        ), counts AS (SELECT words.word, coalesce(max(n) FILTER (WHERE pos > len(s)), 1) AS n FROM words JOIN walk USING (word) GROUP BY words.word),
        sums AS (SELECT r, sum(n)::BIGINT AS n FROM used JOIN counts USING (word) GROUP BY r)
        SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_tokens FROM d LEFT JOIN sums USING (r)
    """,
    "op9_url_filter": r"""
        WITH parts AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), urls AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts
        ), rules(r_host, r_path, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), fits AS (
            SELECT u.*, r_host || r_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS best
            FROM urls u LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE best = 1
    """,
    "op10_decontaminate": r"""
        WITH w AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS win
            FROM (SELECT *, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
        ), ms AS (SELECT DISTINCT m FROM bw),
        dw AS (
            SELECT r, i, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS win
            FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, ms WHERE len(ws) >= m)
        ), hits AS (SELECT r, i, m, item_id FROM dw JOIN bw USING (m, win)),
        words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM hits) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits) GROUP BY r)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM w LEFT JOIN words USING (r) LEFT JOIN items USING (r)
    """,
    "op3_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
        starts AS (
            SELECT r, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS win
            FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
        ), again AS (SELECT r, i FROM starts WHERE win IN (SELECT win FROM starts GROUP BY win HAVING count(*) > 1)),
        marked AS (
            SELECT r, i, word, coalesce(max(CASE WHEN again.i IS NOT NULL THEN 1 ELSE 0 END)
                   OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
            FROM w LEFT JOIN again USING (r, i)
        ), kept AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY r)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
    "op11_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x, length(coalesce(text, '')) AS n FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER best = 1 AS kept, sha256(x) AS text_sha256
        FROM d WINDOW best AS (PARTITION BY x ORDER BY n DESC, doc_id NULLS LAST)
    """,
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
        ), q AS (
            SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark
        ), c AS (SELECT count(*) FILTER (WHERE len(ws) > 0)::BIGINT AS n, sum(len(ws))::BIGINT AS l FROM d),
        qt AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(ws) AS term FROM q) GROUP BY q, item_id, term),
        tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
        w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, n),
        m AS (SELECT r, doc_id, 25 + (75 * len(ws) * n) // l AS m FROM d, c WHERE len(ws) > 0),
        scores AS (
            SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
    """,
}
