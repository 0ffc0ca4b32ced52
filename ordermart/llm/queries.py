"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermart.llm import (
    bpe,
    curve_shards,
    embedding_dedup,
    lexical_search,
    license_scan,
    merkle,
    ngram_join,
    packing,
    pu_learning,
    secret_scan,
    suffix_dedup,
    topk_search,
)
from ordermart.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("key", "hash", "n", "first")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_texts(table(spark, sf_dir, "documents"), path)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return pu_learning.score(docs, pu_learning.learn(docs, labels, "quality"), 0.3)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return pu_learning.score(docs, pu_learning.learn(docs, labels, "toxic"), 0.5)


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.learn(docs))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical_search.search(docs, items)


def op12_curve_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_shards.shard_digest(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_suffix_dedup,
        op3_ngram_join,
        op4_packing,
        op5_embedding_dedup,
        op6_quality,
        op7_topk_search,
        op8_toxicity,
        op9_bpe,
        op10_secret_scan,
        op11_lexical_search,
        op12_curve_shards,
        op13_merkle,
    )
}

#: Rows of `embeddings` that can take part.
USABLE = """
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

#: CRC-32 by a table, over a list of bytes `b` of the row at hand.
CRC_TABLE = """
    crc_bits AS (
        SELECT i, i AS v, 0 AS step FROM range(256) AS r(i)
        UNION ALL
        SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1
        FROM crc_bits WHERE step < 8
    ),
    crc_table AS (SELECT list(v ORDER BY i) AS steps FROM crc_bits WHERE step = 8)
"""
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c >> 8, steps[1 + (xor(c, x) & 255)])), 4294967295)"""

BITS, SHARDS = 8, 24


def _curve_sql() -> str:
    """The Hilbert index of cells x0, x1, x2 of table `cells`, step by step."""
    parts = [("t0", "SELECT * FROM cells")]

    def step(columns: dict[str, str]) -> None:
        changed = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
        last = parts[-1][0]
        parts.append((f"t{len(parts)}", f"SELECT * REPLACE ({changed}) FROM {last}"))

    for bit in range(BITS - 1, 0, -1):
        top, low = 1 << bit, (1 << bit) - 1
        for i in range(3):
            swap = f"(xor(x0, x{i}) & {low})"
            there = f"x{i} & {top} <> 0"
            changed = {"x0": f"CASE WHEN {there} THEN xor(x0, {low}) ELSE xor(x0, {swap}) END"}
            if i:
                changed[f"x{i}"] = f"CASE WHEN {there} THEN x{i} ELSE xor(x{i}, {swap}) END"
            step(changed)
    step({"x1": "xor(x1, x0)"})
    step({"x2": "xor(x2, x1)"})
    flips = ["0"] + [
        f"CASE WHEN x2 & {1 << bit} <> 0 THEN {(1 << bit) - 1} ELSE 0 END"
        for bit in range(1, BITS)
    ]
    flip = flips[0]
    for f in flips[1:]:
        flip = f"xor({flip}, {f})"
    step({f"x{i}": f"xor(x{i}, {flip})" for i in range(3)})
    index = " + ".join(
        f"((x{i} >> {bit}) & 1) * {1 << (bit * 3 + 2 - i)}" for bit in range(BITS) for i in range(3)
    )
    named = ", ".join(f"{name} AS ({sql})" for name, sql in parts)
    return f"{named}, curve AS (SELECT *, {index} AS curve FROM {parts[-1][0]})"


def _cells_sql() -> str:
    """Cells x0, x1, x2 of each document: the middle of its value's rows in order."""
    dims = ("lang", "source", "n_chars")
    spread = ", ".join(
        f"""v{i} AS (
            SELECT {c} AS v, (((2 * (sum(n) OVER (ORDER BY {c}) - n) + n) * {1 << BITS})
                // (2 * sum(n) OVER ()))::BIGINT AS cell
            FROM (SELECT {c}, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c}))"""
        for i, c in enumerate(dims)
    )
    cells = ", ".join(f"coalesce(v{i}.cell, 0) AS x{i}" for i in range(3))
    joins = " ".join(f"LEFT JOIN v{i} ON v{i}.v = d.{c}" for i, c in enumerate(dims))
    return f"{spread}, cells AS (SELECT d.doc_id, d.text, {cells} FROM documents d {joins})"


def _levels_sql(name: str, leaves: str, most: int = 11) -> str:
    """`name`: every node (tree, level, idx, d, n) over table `leaves` (tree, idx, d, n),
    8 to a parent, as long as a tree has several."""
    return f"""
    {name} AS (
        SELECT tree, 0 AS level, idx, d, n FROM {leaves}
        UNION ALL
        SELECT tree, any_value(level) + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)),
               (any_value(n) + 7) // 8
        FROM {name} WHERE n > 1 AND level < {most} GROUP BY tree, idx // 8
    )"""


def _steps_sql(name: str, nodes: str) -> str:
    """`name`: what stands before and after each node among its siblings."""
    return f"""
    {name} AS (
        SELECT a.tree, a.level, a.idx,
               coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS pre,
               coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS post
        FROM {nodes} a JOIN {nodes} b
          ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8
        WHERE a.n > 1
        GROUP BY a.tree, a.level, a.idx
    )"""


def _leaf_sql(text: str) -> str:
    cells = ", ".join(
        f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
        for c in ("doc_id", "source", "lang", "n_chars", text)
    )
    return f"sha256(concat({cells}))"


ORACLE: dict[str, str] = {
    "op3_ngram_join": r"""
        WITH RECURSIVE plain AS (
            SELECT doc_id, array_to_string(list_filter(
                regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> ''), ' ')
                AS words
            FROM documents
        ),
        split AS (SELECT doc_id, string_split(words, ' ') AS w FROM plain WHERE words <> ''),
        shingles AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3),
                    lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
            FROM split
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
            GROUP BY x.doc_id, y.doc_id
        ),
        links AS (
            SELECT a, b
            FROM common c JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE c.n >= 0.8 * (p.n + q.n - c.n)
        ),
        reach AS (
            SELECT a AS node, a AS root FROM links
            UNION
            SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
        ),
        classes AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
        copies AS (SELECT words, min(doc_id) AS copy_id FROM plain WHERE words <> '' GROUP BY words)
        SELECT p.doc_id, coalesce(root, p.doc_id) AS class_id,
               coalesce(copy_id, p.doc_id) AS copy_id, coalesce(n, 0)::BIGINT AS n_links,
               coalesce(root, p.doc_id) = p.doc_id AS kept
        FROM plain p
        LEFT JOIN classes c ON c.node = p.doc_id
        LEFT JOIN counts k ON k.a = p.doc_id
        LEFT JOIN copies y ON y.words = p.words
    """,
    "op5_embedding_dedup": f"""
        WITH RECURSIVE usable AS ({USABLE}),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98
        ),
        reach AS (
            SELECT a AS node, a AS root FROM links
            UNION
            SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
        ),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
        roots AS (SELECT node AS vec_id, min(root) AS root FROM reach GROUP BY node)
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links,
               coalesce(root, e.vec_id) AS component_id,
               coalesce(root, e.vec_id) = e.vec_id AS kept
        FROM embeddings e
        LEFT JOIN counts c ON c.vec_id = e.vec_id LEFT JOIN roots r ON r.vec_id = e.vec_id
    """,
    "op7_topk_search": f"""
        WITH usable AS (
            SELECT vec_id, list_transform(v, lambda x: floor(256 * x)::BIGINT) AS v
            FROM ({USABLE})
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT
                       AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM scored
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_lexical_search": r"""
        WITH doc_terms AS (
            SELECT r, doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
        ),
        counts AS (SELECT r, doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
        lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r),
        corpus AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths),
        weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT
                AS w
            FROM counts, corpus GROUP BY term
        ),
        asked AS (
            SELECT DISTINCT q, item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)
        ),
        scored AS (
            SELECT q, item_id, c.r, c.doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT
                       AS score
            FROM asked JOIN counts c USING (term) JOIN weights USING (term)
            JOIN lengths USING (r), corpus
            GROUP BY q, item_id, c.r, c.doc_id
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)
                AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
    "op12_curve_shards": f"""
        WITH RECURSIVE {CRC_TABLE}, {_cells_sql()}, {_curve_sql()},
        hexed AS (
            SELECT doc_id, curve, hex(encode(coalesce(text, ''))) AS h FROM curve
        ),
        sized AS (
            SELECT doc_id, curve, (length(h) // 2 + 8)::BIGINT AS size,
                   list_transform(regexp_extract_all(h, '..'), lambda x:
                       (strpos('0123456789ABCDEF', x[1]) - 1) * 16
                       + strpos('0123456789ABCDEF', x[2]) - 1) AS b
            FROM hexed
        ),
        summed AS (
            SELECT doc_id, curve, size, {CRC} AS text_crc32 FROM sized, crc_table
        ),
        run AS (
            SELECT *, sum(size) OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST, size
                ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
            FROM summed
        ),
        cut AS (
            SELECT *, (((2 * before + size) * {SHARDS}) // (2 * total))::INTEGER AS shard FROM run
        )
        SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard
                   ORDER BY curve, text_crc32, doc_id NULLS FIRST, size) - 1 AS slot,
               NULL::INTEGER AS grown_shard, curve::BIGINT AS curve
        FROM cut
    """,
    "op13_merkle": f"""
        WITH RECURSIVE {CRC_TABLE},
        bytes AS (
            SELECT *, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT) AS b
            FROM documents
        ),
        touched AS (
            SELECT doc_id, source, lang, n_chars, text,
                   CASE WHEN {CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
            FROM bytes, crc_table
        ),
        leaves AS (
            SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql("text")} AS d,
                   {_leaf_sql("changed")} AS tampered
            FROM touched
        ),
        rows AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS idx,
                   count(*) OVER (PARTITION BY tree) AS n
            FROM leaves
        ),
        {_levels_sql("nodes", "rows")},
        subroots AS (
            SELECT tree AS name, '' AS tree, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx,
                   count(*) OVER () AS n
            FROM nodes WHERE n = 1
        ),
        {_levels_sql("upper", "subroots")},
        top AS (SELECT d AS root FROM upper WHERE n = 1),
        {_steps_sql("steps", "nodes")},
        {_steps_sql("upper_steps", "upper")},
        path AS (
            SELECT r.tree, r.idx, s.level, s.pre, s.post
            FROM rows r JOIN steps s
              ON s.tree = r.tree AND s.idx = r.idx // (8 ** s.level)::BIGINT
            UNION ALL
            SELECT r.tree, r.idx, 100 + s.level, s.pre, s.post
            FROM rows r JOIN subroots u ON u.name = r.tree
            JOIN upper_steps s ON s.idx = u.idx // (8 ** s.level)::BIGINT
        ),
        listed AS (
            SELECT tree, idx, list({{'pre': pre, 'post': post}} ORDER BY level) AS steps,
                   string_agg(pre || post, '' ORDER BY level) AS siblings
            FROM path GROUP BY tree, idx
        ),
        folded AS (
            SELECT r.tree, r.idx, 0 AS up, r.tampered AS x, l.steps
            FROM rows r LEFT JOIN listed l ON l.tree = r.tree AND l.idx = r.idx
            UNION ALL
            SELECT tree, idx, up + 1, sha256(steps[up + 1].pre || x || steps[up + 1].post), steps
            FROM folded WHERE up < coalesce(len(steps), 0)
        )
        SELECT r.doc_id, r.d AS leaf, u.d AS subroot, root,
               sha256(coalesce(siblings, '')) AS proof_sha256, x AS folded_root,
               x = root AS verified
        FROM rows r JOIN subroots u ON u.name = r.tree
        LEFT JOIN listed l ON l.tree = r.tree AND l.idx = r.idx
        JOIN folded f ON f.tree = r.tree AND f.idx = r.idx AND f.up = coalesce(len(f.steps), 0),
        top
    """,
}
