"""The registered queries of this subpackage, with DuckDB equivalents where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.llm import ann, bpe, chat, collocations, cotrain, html_template, line_rules, mixing, simhash, suffix_dedup, token_store, vector_codes, warc
from papyrion.llm.shared import n_words, stored, work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document and back: counts and digests of ids and decoded bytes."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    docs = bpe.decode(docs.drop("text"), ranks, pattern)
    return docs.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document, and the verdict of cross-document line frequency."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid),
l AS (SELECT rid, source, text, line,
             trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
      FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT source, norm FROM l GROUP BY source, norm HAVING count(DISTINCT text) > 20),
r AS (SELECT rid, sum(n) AS gone FROM l JOIN f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(r.gone, 0) AS gone
      FROM w LEFT JOIN dup ON dup.rid = w.rid LEFT JOIN cov ON cov.rid = w.rid LEFT JOIN r ON r.rid = w.rid),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (n_words - gone) * 100 >= n_words * 30) AS kept
FROM v
"""


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix by source weights takes of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.mix(stored(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM s),
u AS (SELECT *, ((sum(source_size) OVER () * 150) / 100.0::DOUBLE
             - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS unit,
             sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM k),
t AS (SELECT source, source_size,
             least(2.0::DOUBLE * source_size, coalesce((SELECT arg_max(unit, open_weight) FROM u WHERE unit * weight <= 2 * source_size) * weight, 2.0::DOUBLE * source_size)) AS target FROM u),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size), d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
"""


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = html_template.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores by text, by metadata and by both, and whether it is kept."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    scored = cotrain.classify(docs, cotrain.clean_labels(_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "text_score", "meta_score", "score", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the component that its links join it to."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to a store and read back: place, length and check sum."""
    path = work_dir(spark, "token-store")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    token_store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation that no other one continues, rendered."""
    return chat.format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP8_SQL = r"""
WITH c AS (SELECT conv_id, list(struct_pack(r := r, t := t) ORDER BY turn, md5(length(r) || ':' || r || t)) AS turns
      FROM (SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
      GROUP BY conv_id),
u AS (SELECT turns, min(conv_id) AS conv_id, count(*)::BIGINT AS n_equal FROM c GROUP BY turns),
k AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u AS o WHERE o.turns[1] = u.turns[1] AND len(o.turns) > len(u.turns) AND o.turns[1:len(u.turns)] = u.turns))
SELECT conv_id, len(turns)::BIGINT AS n_turns, n_equal,
       list_aggregate(list_transform(turns, lambda x: '<|im_start|>' || regexp_replace(x.r, '<\|(im_start|im_end)\|>', '<| \1|>', 'g') || chr(10)
                      || regexp_replace(x.t, '<\|(im_start|im_end)\|>', '<| \1|>', 'g') || '<|im_end|>' || chr(10)), 'string_agg', '') AS chat
FROM k
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of a content-addressed archive, read back from it."""
    path = work_dir(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read_archive(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (i * 5 + 1)::INT, 5))::BIGINT) AS fives FROM h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::INT + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INT + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found of every fiftieth one."""
    return ann.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), query_every=50, k=5)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the 200-byte strings that occur more than once."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT rid, unnest(list_transform(range(0, greatest(len(h) // 2 - 199, 0)), lambda i: struct_pack(i := i, k := md5(substr(h, 2 * i + 1, 400))))) AS s FROM d),
r AS (SELECT rid, s.i AS i FROM n WHERE s.k IN (SELECT s.k FROM n GROUP BY s.k HAVING count(*) > 1)),
o AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM o),
u AS (SELECT rid, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY rid, run),
e AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS before FROM u),
k AS (SELECT e.rid, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
      FROM e JOIN d ON d.rid = e.rid GROUP BY e.rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN k.rid IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON k.rid = d.rid
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by how often their words come together."""
    return collocations.mine(_table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT rid, lang, unnest(range(0, len(pieces))) AS pid, unnest(pieces) AS piece FROM (SELECT rid, lang, string_split_regex(text, '[.,;:!?
-]') AS pieces FROM t)),
s AS (SELECT rid, lang, pid, regexp_extract_all(piece, '[^ 	]+') AS words FROM p),
w AS MATERIALIZED (SELECT rid, lang, pid, unnest(range(0, len(words))) AS i, unnest(words) AS w1 FROM s),
g AS MATERIALIZED (SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4 FROM w WINDOW p AS (PARTITION BY rid, pid ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, [w1] AS ws, count(*) AS f FROM g GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
c AS (SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
cut AS (SELECT c.lang, c.ws, a, k, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f + y.f) AS score
        FROM c JOIN f AS x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f AS y ON y.lang = c.lang AND y.ws = c.ws[k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
sub AS (SELECT lang, ws[i:j] AS ws, max(f) AS most FROM f, range(1, 4) AS x(i), range(2, 5) AS y(j) WHERE j > i AND j <= len(ws) AND j - i + 1 < len(ws) GROUP BY lang, ws[i:j]),
kept AS (SELECT best.* FROM best LEFT JOIN sub ON sub.lang = best.lang AND sub.ws = best.ws WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT),
o AS (SELECT *, array_to_string(ws, ' ') AS phrase FROM kept)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's product code and its error."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP13_SQL = r"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, j, v[4 * j + 1 : 4 * j + 4] AS p FROM e, range(0, 16) AS r(j)),
c0 AS (SELECT j, rid - 1 AS k, p FROM x WHERE rid <= 64),
a0 AS (SELECT rid, j, arg_min(k, d * 64 + k) AS k, min(d) AS d
      FROM (SELECT x.rid, x.j, c.k, list_inner_product(x.p, x.p) - 2 * list_inner_product(x.p, c.p) + list_inner_product(c.p, c.p) AS d FROM x JOIN c0 AS c ON c.j = x.j)
      GROUP BY rid, j),
m0 AS (SELECT j, k, list(mean ORDER BY t) AS p FROM (SELECT x.j, a.k, t, floor(sum(x.p[t]) / count(*)) AS mean FROM x JOIN a0 AS a ON a.rid = x.rid AND a.j = x.j, range(1, 5) AS r(t) GROUP BY x.j, a.k, t) GROUP BY j, k),
c1 AS (SELECT c.j, c.k, coalesce(m.p, c.p) AS p FROM c0 AS c LEFT JOIN m0 AS m ON m.j = c.j AND m.k = c.k),
a1 AS (SELECT rid, j, arg_min(k, d * 64 + k) AS k, min(d) AS d
      FROM (SELECT x.rid, x.j, c.k, list_inner_product(x.p, x.p) - 2 * list_inner_product(x.p, c.p) + list_inner_product(c.p, c.p) AS d FROM x JOIN c1 AS c ON c.j = x.j)
      GROUP BY rid, j),
m1 AS (SELECT j, k, list(mean ORDER BY t) AS p FROM (SELECT x.j, a.k, t, floor(sum(x.p[t]) / count(*)) AS mean FROM x JOIN a1 AS a ON a.rid = x.rid AND a.j = x.j, range(1, 5) AS r(t) GROUP BY x.j, a.k, t) GROUP BY j, k),
c2 AS (SELECT c.j, c.k, coalesce(m.p, c.p) AS p FROM c1 AS c LEFT JOIN m1 AS m ON m.j = c.j AND m.k = c.k),
a2 AS (SELECT rid, j, arg_min(k, d * 64 + k) AS k, min(d) AS d
      FROM (SELECT x.rid, x.j, c.k, list_inner_product(x.p, x.p) - 2 * list_inner_product(x.p, c.p) + list_inner_product(c.p, c.p) AS d FROM x JOIN c2 AS c ON c.j = x.j)
      GROUP BY rid, j),
h AS (SELECT sha256(string_agg(c.p[t]::BIGINT::VARCHAR, ',' ORDER BY j, k, t)) AS codebooks_sha256 FROM c2 AS c, range(1, 5) AS r(t)),
f AS (SELECT rid, string_agg(printf('%02x', k::INT), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN f ON f.rid = e.rid, h
"""


QUERIES = {
    "op1_bpe": op1_bpe, "op2_html_extract": op2_html_extract, "op3_quality_rules": op3_quality_rules, "op4_quality_classifier": op4_quality_classifier, "op5_simhash": op5_simhash, "op6_token_ids": op6_token_ids,
    "op7_mix": op7_mix, "op8_chat": op8_chat, "op9_warc": op9_warc, "op10_ann": op10_ann, "op11_suffix_dedup": op11_suffix_dedup,
    "op12_collocations": op12_collocations, "op13_vector_codes": op13_vector_codes,
}  # fmt: skip
ORACLE_SQL = {"op3_quality_rules": OP3_SQL, "op7_mix": OP7_SQL, "op8_chat": OP8_SQL, "op9_warc": OP9_SQL, "op11_suffix_dedup": OP11_SQL, "op12_collocations": OP12_SQL, "op13_vector_codes": OP13_SQL}
