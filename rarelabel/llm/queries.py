"""One query per operator over whole tables, and SQL where it can state the answer."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, exact_dedup, line_dedup, minhash, mixing, packing, set_join, substring_dedup, token_counts, toxicity, vector_codes, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PIECE_MODEL, BYTE_MODEL = "piece_bpe_32k.model", "byte_bpe_50k.json"
CONTROL = "</s>[INST] ok [/INST]"


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORD_SQL = r"'[^\x20\x09-\x0D]+'"
_ASCII_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_minhash",
    rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER_SQL}, {_WORD_SQL}) AS words FROM documents),
    s AS (SELECT doc_id, unnest(list_distinct(CASE len(words) WHEN 0 THEN [] WHEN 1 THEN words
                 ELSE [words[i] || ' ' || words[i + 1] for i in range(1, len(words))] END)) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id,
           d.doc_id <= coalesce(least.b, d.doc_id) AS kept
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
    """,
)
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query(
    "op2_exact_dedup",
    f"""
    WITH h AS (SELECT doc_id, sha256({_ASCII_LOWER_SQL}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM h WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents")).drop("row")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.toxicity(docs, docs, _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL))


@query("op6_winnowing")
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(_table(spark, sf_dir, "documents"))


@query(
    "op7_substring_dedup",
    rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD_SQL}) AS words FROM documents),
    win AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS p, words FROM w WHERE len(words) >= 20),
    ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(words[p:p + 19], ' ') ORDER BY doc_id, p) AS r FROM win),
    gone AS (SELECT DISTINCT doc_id, p + o AS p FROM ranked, range(20) t(o) WHERE r > 1),
    each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
    kept AS (SELECT e.doc_id, count(*) AS n, count(g.p) AS g, coalesce(string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL), '') AS t
             FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1)
    SELECT d.doc_id, coalesce(n, 0)::bigint AS n_words, coalesce(g, 0)::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept USING (doc_id)
    """,
)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op8_mixing",
    rf"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD_SQL})), 0)::bigint AS size FROM documents),
    s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY 1),
    r AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::double AS weight, 3.0::double * source_size AS most FROM s),
    o AS (SELECT *, most / weight AS ratio, row_number() OVER (ORDER BY most / weight, weight, source) AS k FROM r),
    l AS (SELECT k, ratio, ((SELECT sum(source_size) FROM s)::double - coalesce(sum(most) OVER before, 0)) / sum(weight) OVER after_ AS level
          FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after_ AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    v AS (SELECT min_by(level, k) AS level FROM l WHERE level < ratio),
    t AS (SELECT source, source_size, least(most, weight * level)::double AS target FROM r, v),
    p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                 ('0x' || substr(md5(coalesce('s' || d.source, 'null') || ':{mixing.SEED}'), 1, 15))::bigint / (1::bigint << 60)::double AS u,
                 row_number() OVER (PARTITION BY d.source ORDER BY d.size, ('0x' || substr(md5(d.doc_id::varchar || ':{mixing.SEED}'), 1, 15))::bigint) - 1 AS i
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, (size * least(floor(rate * (i + 1) + u) - floor(rate * i + u), ceil(rate)))::bigint AS taken FROM p
    """,
)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op9_line_dedup",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
          FROM (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l) WHERE key <> ''),
    win AS (SELECT doc_id, p, key || chr(10) || lead(key, 1) OVER o || chr(10) || lead(key, 2) OVER o AS w FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
    ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM win WHERE w IS NOT NULL),
    gone AS (SELECT DISTINCT doc_id, p + o AS p FROM ranked, range(3) t(o) WHERE r > 1),
    kept AS (SELECT l.doc_id, count(u.p) AS n, count(g.p) AS g, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.p IS NULL), '') AS t
             FROM l LEFT JOIN u ON u.doc_id = l.doc_id AND u.i = l.i LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.p = u.p GROUP BY 1)
    SELECT doc_id, n::bigint AS n_lines, g::bigint AS n_removed, sha256(t) AS kept_sha256 FROM kept
    """,
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_lines"), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op9_each_line",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    u AS (SELECT * FROM (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l) WHERE key <> ''),
    ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM u)
    SELECT l.doc_id, count(r) AS n_lines, count(*) FILTER (WHERE r > 1) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE r IS NULL OR r = 1), '')) AS kept_sha256
    FROM l LEFT JOIN ranked ON ranked.doc_id = l.doc_id AND ranked.i = l.i GROUP BY 1
    """,
)
def op9_each_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents"), window=1)
    return found.select("doc_id", F.col("n_units").alias("n_lines"), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op10_chat",
    rf"""
    WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7::bigint, 0::bigint, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')),
    e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g')) + 11 AS written FROM m)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(written)::bigint AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text")
    )
    paths = chat.format_conversations(chat.linear_tree(read.unionByName(added)))
    turns = F.transform(chat.turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = chat.learned_text(F.col("formatted"), F.col("loss_spans"))
    return paths.select(
        "conv_id", F.size(turns).cast("bigint").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query(
    "op11_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
    v AS (SELECT lang, count(*) AS kept, sum(n)::bigint AS total FROM k GROUP BY 1),
    c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
    g AS (SELECT lang, source, coalesce(sum(c.n), 0)::bigint AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
    s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + v.kept) AS p, 1 + (1000000000 * (k.n + 1)) // (v.total + v.kept) AS q
          FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    a AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    f AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
               LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM s WHERE n > 0 AND p > q)
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM f QUALIFY part = 'pair' OR rank <= 200
    """,
)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


@query(
    "op12_jaccard_join",
    rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER_SQL}, {_WORD_SQL}) AS words FROM documents),
    s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                 ELSE [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)] END)) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 90 * (na.n + nb.n - common)),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
    """,
)
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _code_rounds_sql() -> str:
    """Each round of the codebooks as two more steps of one statement."""
    steps = []
    for t in range(vector_codes.ROUNDS + 1):
        steps.append(
            f"""a{t} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min(16 * d + entry) % 16 AS entry, min(16 * d + entry) // 16 AS d
            FROM (SELECT vec_id, p.part, p.x, entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::bigint AS d
                  FROM p JOIN c{t} c ON c.part = p.part) GROUP BY 1, 2)"""
        )
        if t < vector_codes.ROUNDS:
            steps.append(
                f"""c{t + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c{t}.x) AS x FROM c{t} LEFT JOIN
                (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY i) AS x
                 FROM (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{t}, range(1, len(x) + 1) r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, entry))"""
            )
    return ", ".join(steps)


@query(
    "op13_vector_codes",
    f"""
    WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x)::bigint) AS u FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, part, u[part * (len(u) // 8) + 1:(part + 1) * (len(u) // 8)] AS x FROM k, range(8) t(part)),
    c0 AS MATERIALIZED (SELECT part, entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 16),
    {_code_rounds_sql()},
    r AS (SELECT vec_id, string_agg(printf('%02x', entry::int), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM a{vector_codes.ROUNDS} GROUP BY 1),
    b AS (SELECT sha256(string_agg(x[i]::varchar, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM c{vector_codes.ROUNDS}, range(1, len(x) + 1) t(i))
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), b
    """,
)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.encode(_table(spark, sf_dir, "embeddings"))
    found = vector_codes.with_label_error(codes.rows)
    return found.select("vec_id", F.lower(F.hex("owners")).alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
