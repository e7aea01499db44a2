"""The numbered queries: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import round_trip
from .centroids import CLUSTERS, DIMENSION, ROUNDS, elkan_clusters
from .common import table
from .linededup import dedup_lines
from .ngramjoin import ngram_components
from .packing import pack_documents
from .pieces import pieces_round_trip
from .quality import quality_report
from .ranked import TOP, ranked_search
from .secrets import BASE, KINDS, SCOPE, secret_report
from .sharding import shard_documents
from .suffixdedup import dedup_spans
from .vectors import near_vectors, voronoi_top_k


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, law `rows`. A null text has size 1 and checksum 0; null ids sort first, null sources are one; repeated rows
    each have a place; no rows give none. See shard_documents."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the lines that go with repeated windows of three, and the hash of what is left. A null text has no lines and hashes as an
    empty one; ids that repeat or are null count by their texts; no rows give none. See dedup_lines."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding, as digests. A null text is empty: no ids; ids of documents, null or repeated, pass through;
    no rows give none. See round_trip."""
    return round_trip(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens. A null or empty text is its end id; repeated ids are packed each, null ones
    stay null; no rows give none. See pack_documents."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the bytes that a 50-byte string of an earlier document covers. A null text is empty; rows of one id are one document, each
    with its own text; null ids are one document before all others; no rows give none. See dedup_spans."""
    return dedup_spans(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its number of shingles and its component. A null, empty or blank text has none and is alone; a null id keeps its count; of
    ties the smallest id names a component; no rows give none. See ngram_components."""
    return ngram_components(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest scores of every fiftieth vector against all. Null, empty and non-finite vectors and null ids take no part; lengths meet
    their own; ties go to the smaller id; repeated ids count once; no rows give none. See voronoi_top_k."""
    return voronoi_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector its links and component within its label. Null, zero and non-finite vectors and null labels link with nothing; repeated ids
    share one result; a null id has no component; no rows give none. See near_vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document a score by whole text. A null text scores as an empty one; null ids are never learnt from; repeated rows score alike; without
    labels all score 0.5; no rows give none. See quality_report."""
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the secrets in its whole text. A null or empty text has none; repeated rows each have theirs and null ids are kept; no rows
    give none. See find_secrets."""
    return secret_report(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding, as digests. A null text is empty: no ids; ids of documents, null or repeated, pass through;
    no rows give none. See pieces_round_trip."""
    return pieces_round_trip(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector its cluster and squared distance after ten rounds, the sums of distances and the hash of its centroid. Null, shorter, longer
    and non-finite vectors have no row, nor has one beyond the range of long distances; null ids stay null; repeated rows each have one; no
    rows give none. See elkan_clusters."""
    members, centroids = elkan_clusters(table(spark, sf_dir, "embeddings"))
    whole = centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sum("inertia").over(Window.partitionBy()).alias("inertia"), F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))
    return members.join(F.broadcast(whole), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of all for each item of benchmark. Null and empty texts have no terms; null ids come after all others of equal
    score; repeated documents and items each count; items without a match, and no rows, give none. See ranked_search."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_line_dedup, op3_bpe, op4_packing, op5_repeated_spans, op6_ngram_join, op7_top_k, op8_near_vectors, op9_quality, op10_secrets, op11_sentencepiece, op12_centroids, op13_ranked)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1, "op2_line_dedup": OP2, "op5_repeated_spans": OP5, "op6_ngram_join": OP6, "op7_top_k": OP7, "op8_near_vectors": OP8, "op10_secrets": op10_sql(), "op12_centroids": op12_sql(), "op13_ranked": OP13}


OP2 = """
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM documents
), windows AS (
  SELECT doc_id, ls, n, unnest(range(1, n - 1)) AS i FROM lines WHERE n >= 3
), named AS (
  SELECT doc_id, i, concat_ws(chr(10), ls[i], ls[i + 1], ls[i + 2]) AS s FROM windows
), ordered AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM named
  WHERE trim(translate(s, chr(10) || chr(13) || chr(9), '   ')) <> ''
), covered AS (
  SELECT DISTINCT doc_id, i + k AS line FROM ordered, (SELECT unnest(range(0, 3)) AS k) WHERE nth > 1
), flat AS (
  SELECT doc_id, unnest(ls) AS l, unnest(range(1, n + 1)) AS line FROM lines
), marked AS (
  SELECT flat.doc_id, flat.line, l, covered.line IS NOT NULL AS gone,
         coalesce(lag(covered.line IS NOT NULL) OVER (PARTITION BY flat.doc_id ORDER BY flat.line), false) AS was
  FROM flat LEFT JOIN covered ON flat.doc_id = covered.doc_id AND flat.line = covered.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT was) AS n_spans,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP7 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum([q.e[i] * d.e[i] FOR i IN range(1, 65)]) AS BIGINT) AS score
  FROM v AS q JOIN v AS d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), parts AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings AS e LEFT JOIN counts ON counts.a = e.vec_id JOIN parts ON parts.node = e.vec_id
"""

OP1 = """
WITH steps AS (
  SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) FOR n IN range(256)] AS t
), d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b,
         CAST('0x' || substring(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), summed AS (
  SELECT doc_id, source, size, h, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, steps
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS at_share FROM summed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY at_share, source NULLS FIRST, h, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 16 // total AS INTEGER) AS shard, CAST(place - (place * 16 // total * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM placed
"""

#: Bytes as pairs of hex digits; blocks of a thousand keep each cut short.
OP5 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), blocks AS (
  SELECT doc_id, c, substring(h, CAST(2000 * c + 1 AS BIGINT), 2098) AS part FROM (SELECT doc_id, h, unnest(range(0, CAST(ceil(n / 1000) AS BIGINT))) AS c FROM d)
), places AS (
  SELECT doc_id, 1000 * c + i AS p, md5(substring(part, CAST(2 * i + 1 AS BIGINT), 100)) AS s FROM (SELECT doc_id, c, part, unnest(range(0, least(1000, length(part) // 2 - 49))) AS i FROM blocks)
), firsts AS (
  SELECT s, min(doc_id) AS first_id FROM places GROUP BY s
), hits AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS opens FROM places JOIN firsts USING (s) WHERE first_id < doc_id
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS e FROM (SELECT doc_id, p, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_ FROM runs
), kept AS (
  SELECT g.doc_id, string_agg(substring(h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (to_ - from_) AS BIGINT)), '' ORDER BY from_) AS before FROM gaps AS g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id
), sums AS (
  SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(before, '') || substring(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP6 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w
), rows AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows AS a JOIN rows AS b ON a.t = b.t AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT pairs.b, reach.root FROM reach JOIN pairs ON pairs.a = reach.node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM sets JOIN (SELECT node, min(root) AS c FROM reach GROUP BY node) ON node = doc_id
"""


def op10_sql() -> str:
    """Places add up from the pieces between matches, as in find_secrets; the rest are window functions."""
    number = {k[0]: i for i, k in enumerate(KINDS)}
    parts = []
    for i, (name, pattern, least, group) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        value = f"regexp_extract_all(text, '{p}', {group})"
        counts = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')" if name == "token" else f"length(v) >= {least}"
        parts.append(f"SELECT doc_id, {i} AS kind, i, length(m) AS size, length(between_) AS skip, {counts} AS counts FROM (SELECT doc_id, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS i, unnest(regexp_extract_all(text, '{p}')) AS m, unnest({value}) AS v, unnest(string_split_regex(text, '{p}')[1:len(regexp_extract_all(text, '{p}'))]) AS between_ FROM documents WHERE regexp_matches(text, '{p}'))")
    k = lambda *names: ", ".join(str(number[n]) for n in names)
    near = f"OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING)"
    has = lambda *names: f"coalesce(bool_or(kind IN ({k(*names)})) {near}, false)"
    solid = f"kind IN ({k('assign', 'access', 'hex', 'endpoint')})"
    shown = "[" + ", ".join(f"'{x[0]}'" for x in KINDS) + "][kind + 1] || ':' || s || ':' || e"
    return f"""
WITH steps AS ({" UNION ALL ".join(parts)}), placed AS (
  SELECT doc_id, kind, counts, size, CAST(sum(skip + size) OVER (PARTITION BY doc_id, kind ORDER BY i) - size AS BIGINT) AS s FROM steps
), open AS (
  SELECT doc_id, kind, s, s + size AS e FROM placed WHERE counts
), bounds AS (
  SELECT *, max(CASE WHEN {solid} THEN e END) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach,
         min(CASE WHEN {solid} THEN s END) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_ FROM open
), free AS (
  SELECT doc_id, kind, s, e FROM bounds WHERE NOT (kind = {number["token"]} AND (coalesce(reach > s, false) OR coalesce(next_ < e, false)))
), near AS (
  SELECT *, {has("access")} AS access, {has("ident")} AS ident, {has("assign", "hex")} AS secret, {has("token")} AS token, {has("endpoint")} AS endpoint FROM free
), linked AS (
  SELECT * FROM near WHERE kind < {BASE} OR (kind = {number["token"]} AND (access OR (ident AND endpoint))) OR (kind = {number["ident"]} AND (secret OR (token AND endpoint)))
  OR (kind = {number["endpoint"]} AND (access OR ident) AND (secret OR token))
), sums AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg({shown}, ',' ORDER BY s, kind) FILTER (kind < {BASE}) AS base, string_agg({shown}, ',' ORDER BY s, kind) AS spans FROM linked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents AS d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""


def op12_sql() -> str:
    """Every distance in every round; whole numbers in doubles are exact at this size, and distance * 8 + number tells nearest and tie at once."""
    d = DIMENSION
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, [floor({1024} * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings WHERE len(embedding) = {d} AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, e AS c FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, e, key % {CLUSTERS} AS k, key // {CLUSTERS} AS distance FROM (SELECT v.vec_id, v.e, min(CAST(list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c) AS BIGINT) * {CLUSTERS} + k) AS key FROM v, c{r} GROUP BY v.vec_id, v.e))")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT k, i, count(*) AS n, CAST(sum(e[i]) AS BIGINT) AS s FROM a{r}, range(1, {d + 1}) AS t(i) GROUP BY k, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list(CAST((s - (s % n + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM s{r} GROUP BY k) AS m ON m.k = c{r}.k)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string([CAST(x AS BIGINT) FOR x IN c], ',')) AS centroid_sha256 FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS c ON c.k = a.k"""


OP13_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
WITH d AS (
  SELECT doc_id, {OP13_TERMS} AS ts FROM documents
), whole AS (
  SELECT count(*) AS total, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0
), asked AS (
  SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({OP13_TERMS}) AS t FROM benchmark) GROUP BY item_id, t
), postings AS (
  SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t, n
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, whole GROUP BY t, total
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // l)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (t) JOIN weights USING (t), whole GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
