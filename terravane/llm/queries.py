"""The registered queries of this subpackage, and the SQL of those that have some."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, decontaminate, embedding_dedup, html_extract, langid, license_scan, manifest, minhash, quality, suffix_dedup, toxicity
from .common import crc_mod, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digest(bpe.round_trip(table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    field = quality.learn(docs.where("not held_out"), labels)
    return quality.score(docs, field, keep=("doc_id", "held_out"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(html_extract.extract_main_text(table(spark, sf_dir, "pages")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    model = langid.learn(docs.where("not held_out"))
    return langid.identify(docs, model, keep=("doc_id", "held_out"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    model = toxicity.learn(docs.where("not held_out"), labels, toxicity.language_model(docs))
    return toxicity.score(docs, model, keep=("doc_id", "held_out"))


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return {**found, "pipeline": corpus_pipeline.run}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every 50-byte string with the smallest document that it starts in; islands of the bytes that repeated ones cover.
_SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, substring(h, CAST(2 * s + 1 AS BIGINT), 100) AS x FROM d, unnest(range(n - 49)) t(s) WHERE n >= 50),
f AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) < doc_id AS gone FROM w),
g AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM f WHERE gone),
k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM g),
i AS (SELECT doc_id, island, min(s) AS a, max(s) + 50 AS b FROM k GROUP BY ALL),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM i),
c AS (SELECT doc_id, string_agg(substring(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS tail, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substring(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""

#: Turns in order, texts with a backslash before each backslash and control string; turn order by the role before.
_CHAT = r"""
WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
 UNION ALL SELECT -7, k, ['user', 'assistant'][k + 1], '\### Assistant: </turn> ok' FROM range(2) x(k)),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, t) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, t) AS k FROM r),
s AS (SELECT *, coalesce(CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END, false) AS good,
 4 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 END + 2 + length(replace(replace(replace(t, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>')) + 8 AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN t ELSE '' END, '' ORDER BY k)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(good) AND arg_max(role, k) = 'assistant' AS valid FROM s GROUP BY conv_id"""

_REACH = """
r(x, y) AS (SELECT DISTINCT a, a FROM links UNION SELECT r.x, links.b FROM r JOIN links ON links.a = r.y),
least AS (SELECT x, min(y) AS y FROM r GROUP BY x)"""

_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_inner_product(p.e, q.e) / (p.n * q.n) >= 0.98), {_REACH},
c AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(c.n, 0) AS n_links, coalesce(least.y, vec_id) AS component_id, vec_id = coalesce(least.y, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN least ON least.x = vec_id"""

#: All pairs of documents that share a shingle of five words (or all words of shorter texts).
_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS m FROM s p JOIN s q USING (x) WHERE p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE m / (p.n + q.n - m)::DOUBLE >= 0.8 UNION SELECT p.doc_id, q.doc_id FROM d p JOIN d q ON p.text = q.text AND p.doc_id <> q.doc_id), {_REACH}
SELECT doc_id, coalesce(least.y, doc_id) AS class_id, doc_id = coalesce(least.y, doc_id) AS kept FROM documents LEFT JOIN least ON least.x = doc_id"""

#: Every place of every licence word, without the proposal by rare words.
_LICENSES = f"""
WITH p(kind, template, label, word, place, needed, n_needed, n_all) AS (VALUES {license_scan.posting_values()}),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), a AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS spot FROM d),
m AS (SELECT doc_id, kind, template, label, spot - place AS o, n_needed, n_all, count(*) AS n, sum(needed) AS needed FROM a JOIN p USING (word) GROUP BY ALL),
ok AS (SELECT * FROM m WHERE (kind = 'base' AND n = n_all) OR (kind = 'notice' AND needed = n_needed AND n >= 0.6 * n_all)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'base') AS n_base, min(o) FILTER (kind = 'base') AS first_word, max(o) FILTER (kind = 'base') AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base') AS base_labels,
 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(n / n_all::DOUBLE) AS share FROM ok GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
 CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score FROM d LEFT JOIN g USING (doc_id)"""

_LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS x FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) WHERE len(w) > 0),
p AS (SELECT doc_id, k, l, array_to_string(w[k : k + l - 1], ' ') AS x FROM d, (SELECT DISTINCT l FROM i), unnest(range(1, len(w) - l + 2)) t(k)),
h AS (SELECT doc_id, item_id, k, l FROM p JOIN i USING (l, x)),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM h, unnest(range(k, k + l)) t(q) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""


#: Every phrase of each piece, counted by its text.
_PHRASES = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM p, (VALUES (1), (2), (3)) s(k), unnest(range(1, len(w) - k + 2)) r(i) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND a >= 10),
cuts AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, CAST(1000000 * c.a::HUGEINT * c.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score, row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000000 * c.a::HUGEINT * c.a // (x.a::HUGEINT * y.a), cut) AS first
 FROM c, (VALUES (1), (2)) s(cut) JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ') WHERE cut < c.k),
inside AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS part FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT cuts.* FROM cuts LEFT JOIN inside ON inside.lang = cuts.lang AND part = phrase WHERE first = 1 AND (longer IS NULL OR 100 * longer < 50 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"


_OTHERS = "coalesce(string_agg(digest, '') OVER (PARTITION BY tree, h, p // 16 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, h, p // 16 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"

#: crc32 bit by bit over the digits of an id, as DuckDB has no such function; levels of all trees by recursion.
_MANIFEST = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
crc AS (SELECT doc_id, s, 0 AS i, 4294967295::BIGINT AS c FROM ids
 UNION ALL SELECT doc_id, s, i + 1, list_reduce(list_prepend(xor(c, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1])::BIGINT ELSE 0::BIGINT END), [0::BIGINT]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) FROM crc WHERE i < 8 * length(s)),
bad AS (SELECT doc_id FROM crc WHERE i = 8 * length(s) AND xor(c, 4294967295::BIGINT) % 5 = 0),
leaves AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree,
 sha256({" || ".join(_sql_field(c) for c in manifest.FIELDS)}) AS leaf,
 sha256({" || ".join(_sql_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in manifest.FIELDS)}) AS other FROM documents),
low AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
nodes(tree, h, p, digest, n) AS (SELECT tree, 0, p, leaf, count(*) OVER (PARTITION BY tree) FROM low
 UNION ALL SELECT tree, h + 1, p // 16, sha256(string_agg(digest, '' ORDER BY p)), any_value((n + 15) // 16) FROM nodes WHERE n > 1 GROUP BY tree, h, p // 16),
subs AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(tree, h, p, digest, n) AS (SELECT '', 0, p, digest, n FROM subs
 UNION ALL SELECT tree, h + 1, p // 16, sha256(string_agg(digest, '' ORDER BY p)), any_value((n + 15) // 16) FROM tops WHERE n > 1 GROUP BY tree, h, p // 16),
runs AS (SELECT tree, h, p, {_OTHERS} FROM nodes WHERE n > 1),
high AS (SELECT tree, h, p, {_OTHERS} FROM tops WHERE n > 1),
start AS (SELECT low.doc_id, low.tree, low.p, leaf, subs.digest AS subroot, subs.p AS q, CASE WHEN bad.doc_id IS NULL THEN leaf ELSE other END AS x, (SELECT digest FROM tops WHERE n = 1) AS root FROM low JOIN subs USING (tree) LEFT JOIN bad USING (doc_id)),
walk(doc_id, tree, p, q, h, leaf, subroot, root, x, sides) AS (SELECT doc_id, tree, p, q, 0, leaf, subroot, root, x, '' FROM start
 UNION ALL SELECT w.doc_id, w.tree, w.p // 16, w.q, w.h + 1, leaf, subroot, root, sha256(l || x || r), sides || l || r FROM walk w JOIN runs ON runs.tree = w.tree AND runs.h = w.h AND runs.p = w.p),
climb(doc_id, q, h, leaf, subroot, root, x, sides) AS (SELECT doc_id, q, 0, leaf, subroot, root, x, sides FROM walk WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.tree = walk.tree AND runs.h = walk.h)
 UNION ALL SELECT doc_id, q // 16, c.h + 1, leaf, subroot, root, sha256(l || x || r), sides || l || r FROM climb c JOIN high ON high.h = c.h AND high.p = c.q)
SELECT doc_id, leaf, subroot, root, sha256(sides) AS proof_sha256, x AS folded_root, x = root AS verified FROM climb WHERE NOT EXISTS (SELECT 1 FROM high WHERE high.h = climb.h)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": _PHRASES, "op12_manifest": _MANIFEST, "op2_suffix": _SUFFIX, "op3_chat": _CHAT, "op5_vectors": _VECTORS, "op7_minhash": _NEAR, "op8_licenses": _LICENSES, "op10_decontaminate": _LEAKS}
