"""The registered queries of this package: ``opN_<name>`` over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.llm import alignment, common, exact_dedup, html_text, language, mixing, near_dedup, packing, pii, prefix_trie, simhash, token_files, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def enter(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.prepare(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return enter


@query(
    "op5_exact_dedup",
    r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""",
)
def _exact_dedup(table):
    """Every document with the row that stays for its text."""
    return exact_dedup.find_copies(table("documents"))


@query("op6_token_files")
def _token_files(table):
    """Ids of every document, written as byte planes and read back."""
    return token_files.read_index(token_files.write(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), how="spaced", end_id=0))


@query("op7_packing")
def _packing(table):
    """Every document cut into sequences whose lengths are powers of two."""
    return packing.pack(table("documents"), public_tokenizers.path("word_bpe_49k.json"), how="words", end_id=1)


@query(
    "op4_mixing",
    r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mixed FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(rank - 1) % 3 + 1] AS weight, [0.5::DOUBLE, 0.0, -0.5][(rank - 1) % 3 + 1] AS slope FROM s),
l AS (SELECT w.*, (SELECT CAST(sum(x.source_size) AS DOUBLE) FROM w x) - coalesce((SELECT sum(3 * x.source_size) FROM w x WHERE (3 * x.source_size / x.weight, x.rank) < (3 * w.source_size / w.weight, w.rank)), 0) AS rest,
        (SELECT sum(x.weight) FROM w x WHERE (3 * x.source_size / x.weight, x.rank) >= (3 * w.source_size / w.weight, w.rank)) AS among FROM w),
f AS (SELECT rest, among FROM l WHERE rest * weight <= 3 * source_size * among ORDER BY 3 * source_size / weight, rank LIMIT 1),
t AS (SELECT l.source, l.source_size, l.slope, CASE WHEN l.rest * l.weight <= 3 * l.source_size * l.among THEN f.rest * l.weight / f.among ELSE CAST(3 * l.source_size AS DOUBLE) END AS target FROM l, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mixed, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE least(3, greatest(0, floor((target - start - size / 2) / source_size) + 1)) END AS copies,
        CASE WHEN target > 0 THEN start / target ELSE 0.0 END AS asked FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN CASE WHEN slope = 0 THEN asked ELSE (1 + slope - sqrt(greatest(0.0, (1 + slope) * (1 + slope) - 4 * slope * asked))) / (2 * slope) END END AS first_time
FROM c""",
)
def _mixing(table):
    """What the mix takes of every document, and when it is first read."""
    return mixing.plan_mix(table("documents"))


@query("op2_near_dedup")
def _near_dedup(table):
    """Every document with its group of near copies."""
    return near_dedup.find_near_copies(table("documents"), words=4, percent=80)


@query("op3_toxicity")
def _toxicity(table):
    """Every document's toxicity; a fifth of the ids is held out of the fit."""
    return toxicity.score_with_held_out(table("documents"), table("labels"), folds=5, held=0)


@query("op10_language")
def _language(table):
    """Every document's language; a quarter of the ids is held out of the fit."""
    return language.predict_with_held_out(table("documents"), folds=4, held=2)


@query(
    "op9_topk",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
)
def _topk(table):
    """The ten best other rows of every hundredth vector."""
    return topk.top_k(table("embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op8_html_text")
def _html_text(table):
    """The main text of every page."""
    return html_text.extract_text(table("pages"))


@query("op1_pii")
def _pii(table):
    """Spans of personal data in every document."""
    return pii.report(table("documents"))


@query("op11_alignment")
def _alignment(table):
    """Tokens of two vocabularies aligned in every document, with corpus-wide counts of linked pairs."""
    return alignment.align_corpus(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op12_prefix_trie",
    r"""WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(concat(octet_length(encode(coalesce(role, ''))), ':', role, text)), 1, 32)) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v // 2, 3988292384 * (v % 2)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, o.d, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.d <= c.h
  UNION ALL SELECT c.conv_id, o.d + 4, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.d > c.h),
p AS (SELECT c.conv_id, coalesce(list(struct_pack(r := r.role, t := r.text) ORDER BY r.d) FILTER (r.d IS NOT NULL), []) AS path FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, len(path) AS size, unnest(range(0, len(path) + 1)) AS depth, path FROM p),
n AS (SELECT depth, path[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth].t, '[^ 	-
]+')) END AS saved
  FROM n LEFT JOIN k USING (depth, prefix)),
a AS (SELECT up AS depth, prefix[1:up] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN a USING (depth, prefix) LEFT JOIN n u ON u.depth = f.depth - 1 AND u.prefix = f.prefix[1:f.depth - 1]""",
)
def _prefix_trie(table):
    """Every shared prefix of the rebuilt conversations."""
    return prefix_trie.rebuilt_trie(table("conversations"))


@query("op13_simhash")
def _simhash(table):
    """Every document with its fingerprint and its group of near copies."""
    return simhash.find_near_copies(table("documents"), words=3, radius=2)
