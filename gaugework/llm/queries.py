"""Registered queries of the subpackage, each a thin use of its operator, and their comparison SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugework.llm import chat, exact, language, leaks, lexical, mixing, near, pages, phrases, quality, repeats, toxic, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(parts: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


@query(
    "op7_exact_duplicates",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


MIX_SQL = r"""
    WITH RECURSIVE items AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
    ), totals AS (
        SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
        FROM items GROUP BY source
    ), filled AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
        FROM totals WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), goals AS (
        SELECT source, source_size, least(3.0 * source_size, weight * max(level) OVER ())::DOUBLE AS target FROM filled
    ), sizes AS (
        SELECT source, size, count(*) AS n FROM items GROUP BY ALL
    ), bounds AS (
        SELECT g.source, g.target, max(s.size) AS largest FROM goals g JOIN sizes s ON s.source IS NOT DISTINCT FROM g.source AND s.size > 0
        WHERE g.target > 0 AND g.target < 3.0 * (1 - 1e-12) * g.source_size GROUP BY ALL
    ), newton AS (
        SELECT source, target, largest, 0.0::DOUBLE AS m, -1e7::DOUBLE AS lo, 1e7::DOUBLE AS hi, 0 AS step FROM bounds
        UNION ALL
        SELECT source, target, largest,
               CASE WHEN abs(off) <= 1e-13 * target THEN m
                    WHEN slope > 0 AND m - off / slope > CASE WHEN off < 0 THEN m ELSE lo END AND m - off / slope < CASE WHEN off > 0 THEN m ELSE hi END THEN m - off / slope
                    ELSE (CASE WHEN off < 0 THEN m ELSE lo END + CASE WHEN off > 0 THEN m ELSE hi END) / 2 END,
               CASE WHEN off < 0 THEN m ELSE lo END, CASE WHEN off > 0 THEN m ELSE hi END, step + 1
        FROM (SELECT w.source, w.target, w.largest, w.m, w.lo, w.hi, w.step,
                     sum(s.n * s.size * least(exp(least(w.m * (s.size / w.largest), 700.0)), 3.0)) - w.target AS off,
                     sum(CASE WHEN exp(least(w.m * (s.size / w.largest), 700.0)) < 3.0 THEN s.n * s.size * (s.size / w.largest) * exp(least(w.m * (s.size / w.largest), 700.0)) ELSE 0 END) AS slope
              FROM newton w JOIN sizes s ON s.source IS NOT DISTINCT FROM w.source AND s.size > 0 WHERE w.step < 64 GROUP BY w.source, w.target, w.largest, w.m, w.lo, w.hi, w.step)
    ), plan AS (
        SELECT g.*, w.m, w.largest FROM goals g LEFT JOIN newton w ON w.source IS NOT DISTINCT FROM g.source AND w.step = 64
    ), rated AS (
        SELECT i.doc_id, i.size, p.source, p.source_size, p.target,
               floor(1000000 * CASE WHEN i.size = 0 OR p.target <= 0 THEN 0.0 WHEN p.m IS NULL THEN 3.0
                                    ELSE least(exp(least(p.m * (i.size / p.largest), 700.0)), 3.0) END + 0.5)::BIGINT AS rate
        FROM items i JOIN plan p ON i.source IS NOT DISTINCT FROM p.source
    ), ranked AS (
        SELECT *, (sum(rate) OVER (PARTITION BY source ORDER BY size DESC, doc_id % 2147483647 * 1327217885 % 2147483647 // 8388608, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM rated
    ), tried AS (
        SELECT source, target, phase, sum(size * ((upto + phase) // 1000000 - (upto - rate + phase) // 1000000)) AS words
        FROM ranked, (SELECT (2 * range + 1) * 15625 AS phase FROM range(32)) GROUP BY ALL
    ), best AS (
        SELECT source, arg_min(phase, (abs(words - target), phase)) AS phase, arg_min(target - words, (abs(words - target), phase)) AS gap
        FROM tried GROUP BY source
    ), rounded AS (
        SELECT r.* EXCLUDE (upto), b.gap,
               CASE WHEN size > 0 THEN ((upto + phase) // 1000000 - (upto - rate + phase) // 1000000)::BIGINT ELSE 1 END AS copies
        FROM ranked r JOIN best b ON r.source IS NOT DISTINCT FROM b.source
    ), able AS (
        SELECT *, size > 0 AND CASE WHEN gap > 0 THEN copies + 1 <= 3 ELSE copies > 0 END AS can FROM rounded
    ), reached AS (
        SELECT *, sum(size) OVER (PARTITION BY source, can ORDER BY size, doc_id % 2147483647 * 1327217885 % 2147483647 // 8388608, doc_id ROWS UNBOUNDED PRECEDING) - 0.5 * size AS upto
        FROM able
    )
    SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
           (size * (copies + CASE WHEN can AND upto <= abs(gap) THEN sign(gap) ELSE 0 END))::BIGINT AS taken
    FROM reached
"""


@query("op6_entropy_mix", MIX_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    mix = mixing.entropy_mix(documents, share=mixing.dealt(F.col("doc_id")))
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


CHAT_SQL = r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), marked AS (
        SELECT *, coalesce(role <> lag(role) OVER w, true) AS opens, coalesce(role <> lead(role) OVER w, true) AS closes,
               length(text) + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<\|begin_of_text\|>|<\|start_header_id\|>|<\|end_header_id\|>|<\|eot_id\|>|</?s>|<</?SYS>>|<start_of_turn>|<end_of_turn>|\[/?INST\]|␛')) AS chars
        FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(chars + CASE WHEN opens THEN 13 + length(role) ELSE 10 END + CASE WHEN closes THEN 11 ELSE 0 END)::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id
"""


@query("op9_chat_format", CHAT_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(chat.with_turns(table(spark, folder, "conversations"), extra))
    back = chats.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


NEAR_SQL = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
        SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9
    ), reach AS (
        SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
    ), classes AS (
        SELECT x, min(y) AS y FROM reach GROUP BY x
    )
    SELECT d.doc_id, least(d.doc_id, coalesce(k.y, d.doc_id)) AS class_id,
           (SELECT count(*) FROM links l WHERE l.x = d.doc_id) AS n_links, coalesce(s.n, 0) AS n_shingles,
           d.doc_id = least(d.doc_id, coalesce(k.y, d.doc_id)) AS kept
    FROM documents d LEFT JOIN classes k ON k.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@query("op8_near_duplicates", NEAR_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


@query("op4_toxic_field")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    field = toxic.fit(documents, table(spark, folder, "labels"), fold(4) != 2)
    scored = toxic.score(documents, field)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


LEAK_SQL = r"""
    WITH docs AS (
        SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents
    ), items AS (
        SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark
    ), pieces AS (
        SELECT item_id, len(w) AS n, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS c
        FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items WHERE len(w) >= 5) GROUP BY ALL
    ), runs AS (
        SELECT doc_id, len(w) AS m, i, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)
    ), starts AS (
        SELECT DISTINCT doc_id, item_id, n, least(n, m) AS k, start
        FROM (SELECT r.doc_id, r.m, p.item_id, p.n, unnest(range(greatest(r.i - p.n + 5, 1), least(r.i, greatest(r.m - p.n + 1, 1)) + 1)) AS start
              FROM runs r JOIN pieces p ON p.s = r.s)
    ), inside AS (
        SELECT t.doc_id, t.item_id, t.n, t.k, t.start, r.s, count(*) AS c
        FROM starts t JOIN runs r ON r.doc_id = t.doc_id AND r.i BETWEEN t.start AND t.start + t.k - 5 GROUP BY ALL
    ), alike AS (
        SELECT x.doc_id, x.item_id, x.n, x.k, x.start, sum(least(x.c, p.c)) AS shared
        FROM inside x JOIN pieces p ON p.item_id = x.item_id AND p.s = x.s GROUP BY ALL
    ), scored AS (
        SELECT doc_id, item_id, k, start, shared::DOUBLE / ((n - 4) + (k - 4) - shared) AS similarity FROM alike
    )
    SELECT doc_id, item_id, round(max(similarity), 9) AS similarity, (arg_max(start, (similarity, -start)) - 1)::BIGINT AS start_word,
           arg_max(k, (similarity, -start))::BIGINT AS n_words
    FROM scored WHERE similarity >= 0.8 GROUP BY ALL
"""


@query("op3_benchmark_leaks", LEAK_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "start_word", "n_words")


@query("op1_quality_trees")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"), fold(5) != 0)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


PAGE_SQL = r"""
    WITH inner_html AS (
        SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g') AS body FROM pages
    ), decoded AS (
        SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(body, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM inner_html
    )
    SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM decoded
"""


@query("op5_main_text", PAGE_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


@query("op10_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    told = language.languages(documents, language.dictionaries(documents, fold(3) != 1))
    return told.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op2_repeated_bytes")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeated_bytes(table(spark, folder, "documents")).drop("removed")


SEARCH_SQL = r"""
    WITH docs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM documents
    ), tf AS (
        SELECT doc_id, term, count(*) AS tf FROM docs GROUP BY ALL
    ), lengths AS (
        SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
    ), totals AS (
        SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths
    ), items AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM benchmark
    ), weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term
    ), scored AS (
        SELECT i.item_id, t.doc_id, sum(w.w * (1000000000 * t.tf // (1000 * t.tf + 8 * (10 + 90 * l.n * big_n // big_l))))::BIGINT AS score
        FROM items i JOIN tf t ON t.term = i.term JOIN weights w ON w.term = i.term JOIN lengths l ON l.doc_id = t.doc_id, totals
        GROUP BY ALL
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_lexical_search", SEARCH_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_nearest_vectors")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


PHRASE_SQL = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ), words AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), grams AS (
        SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS g
        FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words CROSS JOIN (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)
    ), counts AS (
        SELECT lang, size, g, count(*) AS f FROM grams GROUP BY ALL
    ), totals AS (
        SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
    ), candidates AS (
        SELECT lang, size, g, f, string_split(g, ' ') AS w FROM counts WHERE size > 1 AND f >= 10
    ), ways AS (
        SELECT lang, size, g, f AS a, k, array_to_string(w[:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two
        FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
    ), cut AS (
        SELECT c.lang, c.size, c.g, c.a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM ways c JOIN counts l ON l.lang = c.lang AND l.g = c.one JOIN counts r ON r.lang = c.lang AND r.g = c.two
    ), scored AS (
        SELECT lang, size, g, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM cut GROUP BY ALL
    ), inner_pairs AS (
        SELECT lang, array_to_string(w[1:2], ' ') AS g, f FROM candidates WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM candidates WHERE size = 3
    ), longest AS (
        SELECT lang, g, max(f) AS most FROM inner_pairs GROUP BY ALL
    ), kept AS (
        SELECT s.* FROM scored s LEFT JOIN longest p ON p.lang = s.lang AND p.g = s.g WHERE s.size = 3 OR p.most IS NULL OR 100 * p.most < 50 * s.a
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g)::INT AS rank, g AS phrase, a, l, r, n, score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op13_phrases", PHRASE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))
