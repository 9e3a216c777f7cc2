"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, embed_dedup, exact_dedup, licenses, packing, periodic, piece_match, prefix_trie, simhash, tokenfile, toxicity, warc
from .common import table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), word_tokenizer())


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(says))
    return chat.window_digests(chat.chat_windows(turns.union(probe)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_match.encode_and_decode(table(spark, sf_dir, "documents"), piece_model())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), prepare=periodic.plant_periods))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.id_digests(byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_token_files,
        op3_chat_windows,
        op4_sentencepiece,
        op5_exact_dedup,
        op6_toxicity,
        op7_warc,
        op8_license_scan,
        op9_embedding_near_dedup,
        op10_simhash_near_dedup,
        op11_prefix_trie,
        op12_periodic_runs,
        op13_byte_bpe,
    )
}

#: crc32 in SQL: ``tab`` has the one-row list t of its byte table; {0} is an integer, whose decimal is hashed.
CRC_TABLE = """tab AS (
    SELECT list(v ORDER BY n) AS t FROM (
        SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n)))"""
CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
WORDS_SQL = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_prefix_trie": f"""
        WITH {CRC_TABLE},
        turns AS (
            SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
            FROM conversations),
        convs AS (SELECT c, n, {CRC.format("c")} % 4 AS h, c - c % 20 AS b FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), tab),
        built AS (
            SELECT k.c, t.p, t.r, t.x FROM convs k JOIN turns t ON t.c = k.b AND t.p <= k.h
            UNION ALL SELECT k.c, t.p, t.r, t.x FROM convs k JOIN turns t ON t.c = k.c AND t.p > k.h),
        lists AS (SELECT k.c, coalesce(list({{'r': t.r, 'x': t.x}} ORDER BY t.p) FILTER (t.p IS NOT NULL), []) AS l FROM convs k LEFT JOIN built t ON t.c = k.c GROUP BY k.c),
        members AS (SELECT c, l, d, l[1:d] AS pre FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM lists)),
        nodes AS (
            SELECT pre, d, min(c) AS c, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE len({WORDS_SQL.format("any_value(l[d].x)")}) END AS words,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends
            FROM members GROUP BY pre, d),
        below AS (SELECT pre[1:d - 1] AS up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
        own AS (SELECT v.*, coalesce(b.n, 0) AS n_children FROM nodes v LEFT JOIN below b ON b.up = v.pre),
        totals AS (
            SELECT pre[1:e] AS top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * words) AS saved
            FROM (SELECT pre, n_children, n_convs, words, unnest(range(d + 1)) AS e FROM own) GROUP BY ALL)
        SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, u.c AS parent_conv_id, v.n_convs, v.n_children,
               CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
        FROM own v JOIN totals t ON t.top = v.pre LEFT JOIN own u ON v.d > 0 AND u.d = v.d - 1 AND u.pre = v.pre[1:v.d - 1]
    """,
    "op12_periodic_runs": f"""
        WITH {CRC_TABLE},
        plain AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w, {CRC.format("doc_id")} AS h FROM documents, tab),
        marked AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, h // 10 AS g FROM plain),
        placed AS (SELECT *, CASE WHEN hit THEN g % n END AS a FROM marked),
        tails AS (SELECT *, CASE WHEN hit THEN 1 + (n - a) // (3 + g % 8) END AS p FROM placed),
        pos AS (
            SELECT doc_id, n, i, CASE WHEN hit AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS word
            FROM (SELECT *, unnest(range(n)) AS i FROM tails)),
        same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        stretches AS (
            SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same)
            GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
        runs AS (
            SELECT * FROM stretches x WHERE NOT EXISTS (
                SELECT 1 FROM stretches y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
        listed AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM runs GROUP BY doc_id),
        best AS (SELECT * FROM runs x WHERE NOT EXISTS (
            SELECT 1 FROM runs y WHERE y.doc_id = x.doc_id AND (y.l * x.q > x.l * y.q OR (y.l * x.q = x.l * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q)))))),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
        kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS txt FROM pos p ANTI JOIN dropped d ON d.doc_id = p.doc_id AND d.i = p.i GROUP BY p.doc_id)
        SELECT m.doc_id, coalesce(r.n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
               sha256(coalesce(r.txt, '')) AS runs_sha256, sha256(coalesce(k.txt, '')) AS collapsed_sha256
        FROM marked m LEFT JOIN listed r ON r.doc_id = m.doc_id LEFT JOIN best b ON b.doc_id = m.doc_id LEFT JOIN kept k ON k.doc_id = m.doc_id
    """,
}
