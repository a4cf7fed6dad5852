"""The registered queries of this subpackage, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm import bpe_chunks, brown_lm, chat_grammar, cube_mix, dart_minhash, exact_dedup, merkle_manifest, phrases, piece_language, pii_weak, suffix_dedup, topk_threshold, toxicity_mil
from pairloom.llm.common import id_crc, table
from pairloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def word_bpe_path() -> str:
    """The tokenizer that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digests(docs: DataFrame) -> DataFrame:
    coded = bpe_chunks.encode(docs.select("doc_id", "text"), word_bpe_path())
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op1_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


@query("""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
     r AS (SELECT doc_id, sha256(t) AS d, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS i,
                  min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, i = 1 AS kept, d AS text_sha256 FROM r
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query()
def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""")
def op4_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_threshold.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query()
def op5_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube_mix.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@query()
def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", F.col("keeper").alias("kept"))


@query()
def op7_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_mil.score(docs, toxicity_mil.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (id_crc() % 3 == 1).alias("held_out"), "score",
        (F.col("score") >= toxicity_mil.TOXIC).cast("int").alias("predicted"), F.size("offending").alias("n_offending"),
    )


PLANTED = r"\### Assistant: </turn> ok"


@query(r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, contains(text, '</turn>') OR contains(text, '### ') OR contains(role, ':') OR contains(role, '</turn>') OR right(role, 1) = '\' AS esc,
         replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS etext,
         replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ':', '\:') AS erole FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN esc THEN 15 + length(etext) + length(erole) ELSE 14 + length(text) + length(role) END) AS BIGINT) AS formatted_chars,
       true AS round_trip
FROM t GROUP BY conv_id
""")
def op8_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"),
    )
    return chat_grammar.digests(chat_grammar.format_conversations(turns.unionByName(planted)))


@query()
def op9_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_weak.personal_data(table(spark, sf_dir, "documents"))
    of = [F.size(F.filter("base", lambda x: x["kind"] == F.lit(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii_weak.KINDS)]
    return out.select(F.col("id").alias("doc_id"), *of, F.sha2(pii_weak.text_of(F.col("base")), 256).alias("base_sha256"), pii_weak.text_of(F.col("spans")).alias("spans"))


_LEAF = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in merkle_manifest.FIELDS)
_ROUND = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"  # eight bits of a crc32


def _tree(name: str, key: str, leaves: str) -> str:
    """CTEs of all nodes by level: the sources' trees, or the one above them."""
    return f"""{name} AS (SELECT 0 AS lvl, {key}, pos, h FROM {leaves} UNION ALL
        SELECT lvl + 1, {key}, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
        FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS c FROM {name}) WHERE c > 1 GROUP BY lvl, {key}, pos // 3)"""


def _path(of: str, tree: str, key: str, first: str) -> str:
    """For each node of ``of`` the siblings left and right of its path, level by level, until its tree's root."""
    return f"""(SELECT o.{key}, o.pos, {first} + n.lvl AS step, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < n.pos), '') AS l,
               coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > n.pos), '') AS r
        FROM {of} o JOIN {tree} n ON n.{key} IS NOT DISTINCT FROM o.{key} AND n.pos = o.pos // CAST(3 ** n.lvl AS BIGINT)
        JOIN {tree} b ON b.{key} IS NOT DISTINCT FROM n.{key} AND b.lvl = n.lvl AND b.pos // 3 = n.pos // 3
        WHERE n.lvl < (SELECT max(lvl) FROM {tree} m WHERE m.{key} IS NOT DISTINCT FROM o.{key}) GROUP BY ALL)"""


@query(f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_LEAF}) AS h, doc_id IS NOT NULL AND text IS NOT NULL
         AND (list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
              lambda x0, b: list_reduce(list_transform([xor(x0, b)], lambda x: {_ROUND}), lambda p, q: p)) & 1) = 1 AS touched, lang, n_chars, text
  FROM documents),
t AS (SELECT doc_id, source, h, CASE WHEN touched THEN sha256({_LEAF.replace("text::", "replace(text, chr(10), '')::")}) ELSE h END AS h2,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM d),
{_tree("up", "source", "t")},
subs AS (SELECT source, max_by(h, lvl) AS h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, 0 AS one FROM up GROUP BY source),
{_tree("top", "one", "subs")},
whole AS (SELECT max_by(h, lvl) AS root FROM top),
low AS {_path("t", "up", "source", "0")},
high AS {_path("subs", "top", "one", "100")},
path AS (SELECT t.source, t.pos, step, l, r FROM t JOIN low ON low.source IS NOT DISTINCT FROM t.source AND low.pos = t.pos UNION ALL
         SELECT t.source, t.pos, step, l, r FROM t JOIN subs ON subs.source IS NOT DISTINCT FROM t.source JOIN high ON high.pos = subs.pos),
steps AS (SELECT *, row_number() OVER (PARTITION BY source, pos ORDER BY step) AS i FROM path),
fold AS (SELECT source, pos, 0::BIGINT AS i, h2 AS x FROM t UNION ALL
         SELECT f.source, f.pos, f.i + 1, sha256(s.l || f.x || s.r) FROM fold f JOIN steps s
           ON s.source IS NOT DISTINCT FROM f.source AND s.pos = f.pos AND s.i = f.i + 1),
ends AS (SELECT source, pos, max_by(x, i) AS folded_root FROM fold GROUP BY ALL),
proofs AS (SELECT source, pos, sha256(string_agg(l || r, '' ORDER BY i)) AS proof FROM steps GROUP BY ALL)
SELECT t.doc_id, t.h AS leaf, subs.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM t CROSS JOIN whole JOIN subs ON subs.source IS NOT DISTINCT FROM t.source
JOIN ends ON ends.source IS NOT DISTINCT FROM t.source AND ends.pos = t.pos
LEFT JOIN proofs ON proofs.source IS NOT DISTINCT FROM t.source AND proofs.pos = t.pos
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents")).drop("source")


@query(r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
covered AS (SELECT DISTINCT s.lang, s.g FROM f s JOIN (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS part FROM f WHERE len(g) = 3) b
            ON b.lang = s.lang AND b.part = s.g AND 100 * b.a >= 50 * s.a),
parts AS MATERIALIZED (SELECT lang, g, a, k, g[1:k] AS head, g[k + 1:] AS tail FROM f, (SELECT unnest([1, 2]) AS k) WHERE k < len(g)),
heads AS MATERIALIZED (SELECT p.*, x.a AS l FROM parts p JOIN f x ON x.lang = p.lang AND x.g = p.head),
cut AS (SELECT h.lang, h.g, h.a, k, l, y.a AS r, (1000000::HUGEINT * h.a * h.a) // (l::HUGEINT * y.a) AS score
        FROM heads h JOIN f y ON y.lang = h.lang AND y.g = h.tail
        QUALIFY row_number() OVER (PARTITION BY h.lang, h.g ORDER BY score, k) = 1),
s AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM cut ANTI JOIN covered USING (lang, g))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""")
def op11_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pieces_path() -> str:
    """The vocabulary whose pieces language identification uses; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query()
def op12_piece_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = piece_language.predict(docs.select("doc_id", "text"), piece_language.fit(docs, pieces_path()))
    return found.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")
