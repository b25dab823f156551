"""The queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labframe.llm import byte_bpe, decontamination, divergence, license_scan, media, near_dup, pii, sharding, substring_dedup, token_counts, toxicity, vector_codes, warc
from labframe.llm.common import documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scored(docs, toxicity.fitted(docs, labels))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=5)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = byte_bpe.encoded(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    ids = F.col("ids")
    return rows.select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(byte_bpe.little_endian(ids), 256).alias("ids_sha256"), F.sha2(byte_bpe.decoded(ids, ranks), 256).alias("decoded_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(documents(spark, sf_dir))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), shingle=2)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(documents(spark, sf_dir)))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(g) AS n FROM win),
p AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS p FROM d, n),
h AS (SELECT DISTINCT doc_id, item_id, p, n FROM (SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS g FROM p) JOIN win USING (g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1),
tw AS (SELECT item_id, w, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM (SELECT DISTINCT item_id, w FROM i) WHERE len(w) > 0),
post AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d), cnt AS (SELECT word, count(*) AS n FROM post WHERE word IN (SELECT word FROM tw) GROUP BY 1),
inside AS (SELECT item_id, w, pos, word, n, unnest(range(greatest(0, pos - 9), greatest(0, least(pos, len(w) - 10)) + 1)) AS start FROM tw JOIN cnt USING (word)),
one AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY item_id, w, start ORDER BY n, word, pos) = 1),
two AS (SELECT inside.*, one.pos AS a_at, one.word AS a_word FROM inside JOIN one USING (item_id, w, start) WHERE inside.word <> one.word QUALIFY row_number() OVER (PARTITION BY item_id, w, start ORDER BY inside.n, inside.word, inside.pos) = 1),
pair AS (SELECT DISTINCT item_id, w, a_at, a_word, pos AS b_at, word AS b_word FROM two),
q AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT x.doc_id, item_id, w FROM pair JOIN post x ON x.word = a_word JOIN post y ON y.word = b_word AND y.doc_id = x.doc_id AND abs((x.pos - a_at) - (y.pos - b_at)) <= 5) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN q USING (doc_id)"""

NEAR_DUP_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [[w[1]]] ELSE list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, min(b) = a AS kept FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY a"""


WARC_SQL = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def _codes_sql() -> str:
    """Rounds written out; a part is a list of whole numbers."""
    n, k, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {vector_codes.SCALE})::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {n} + 1 : (p + 1) * len(v) // {n}] AS x FROM v, range({n}) r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, p, x, min(d) AS d, arg_min(e, (d, e)) AS e FROM (SELECT vec_id, label, x.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{i} c ON c.p = x.p) GROUP BY vec_id, label, p, x)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS x, unnest(range(len(x))) AS i FROM a{i}) GROUP BY 1, 2, 3), f{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{i} GROUP BY 1, 2)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(f.c, o.c)::BIGINT[] AS c FROM c{i} o LEFT JOIN f{i} f USING (p, e))")
    return f"""WITH {", ".join(steps)}, o AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1, 2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM o"""


DIVERGENCE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS MATERIALIZED (SELECT row, lang, source, unnest(w) AS term FROM d), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM tok GROUP BY 1, 2 HAVING count(DISTINCT row) >= {divergence.LEAST}), v AS (SELECT lang, count(*) AS v, sum(total) AS lang_total FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY 1, 2, 3), f AS (SELECT g.lang, g.source, term, total, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS group_total FROM f),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + ({divergence.SCALE}::HUGEINT * (n + {divergence.SMOOTH})) // (group_total + {divergence.SMOOTH} * v) AS p, 1 + ({divergence.SCALE}::HUGEINT * (total + {divergence.SMOOTH})) // (lang_total + {divergence.SMOOTH} * v) AS q FROM s JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= {divergence.TOP}"""


def _license_sql() -> str:
    """Runs may end anywhere: a pair counts from the first line at which it is complete, summed over the lines after a start."""
    quoted = ", ".join("('{}', {}, '{}')".format(name, i, text.replace("'", "''")) for i, (name, text) in enumerate(license_scan.TEMPLATES))
    words = f"list_filter(regexp_split_to_array({{}}, '{license_scan.BREAKS}'), lambda x: x <> '')"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""WITH t AS (SELECT license, template, w, {pairs} AS p FROM (SELECT license, template, {words.format(lower.format("text"))} AS w FROM (VALUES {quoted}) v(license, template, text))),
tp AS (SELECT template, unnest(p) AS pair FROM t), f AS (SELECT DISTINCT w[1] || ' ' || w[2] AS pair FROM t WHERE len(w) > 1),
raw AS (SELECT doc_id, unnest(range(0, len(l))) AS line, len(l) AS lines, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
l AS MATERIALIZED (SELECT doc_id, line, lines, w, coalesce(w[1] = 'copyright' OR (w[1] = 'c' AND (w[2] = 'copyright' OR regexp_full_match(w[2], '[0-9]+'))), false) AS named FROM (SELECT doc_id, line, lines, {words.format(lower.format("text"))} AS w FROM raw)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, line FROM (SELECT *, unnest(range(1, len(w))) AS i FROM l WHERE NOT named) WHERE w[i] || ' ' || w[i + 1] IN (SELECT pair FROM f)),
x AS (SELECT doc_id, line, unnest(w) AS word, unnest(range(len(w))) AS i FROM l WHERE NOT named AND doc_id IN (SELECT doc_id FROM s)),
y AS MATERIALIZED (SELECT doc_id, line, word || ' ' || lead(word) OVER o AS pair, lead(line) OVER o AS done FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY line, i)),
fresh AS MATERIALIZED (SELECT s.doc_id, s.line, pair, min(done) AS done FROM s JOIN y ON y.doc_id = s.doc_id AND y.line >= s.line AND pair IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT doc_id, line, done, sum(count(*)) OVER (PARTITION BY doc_id, line ORDER BY done) AS n FROM fresh GROUP BY 1, 2, 3),
c AS (SELECT doc_id, line, template, done, sum(count(*)) OVER (PARTITION BY doc_id, line, template ORDER BY done) AS c FROM fresh JOIN tp USING (pair) GROUP BY 1, 2, 3, 4),
e AS (SELECT n.doc_id, n.line, n.done, n.n, t.license, t.template, len(t.p) AS size, (SELECT max(c.c) FROM c WHERE c.doc_id = n.doc_id AND c.line = n.line AND c.template = t.template AND c.done <= n.done) AS c FROM n JOIN t ON n.n BETWEEN len(t.p) * 0.8 AND len(t.p) * 1.25 WHERE n.done > n.line),
u AS (SELECT doc_id, line, w FROM l UNION ALL SELECT doc_id, -1, flatten(list(w ORDER BY line)) FROM l WHERE NOT named AND lines > 1 GROUP BY doc_id), p AS (SELECT doc_id, line, {pairs} AS p FROM u),
m AS (SELECT doc_id, line, license, template, 2 * len(list_intersect(p.p, t.p)) / (len(p.p) + len(t.p)) AS dice FROM p JOIN t ON len(p.p) BETWEEN len(t.p) * 0.8 AND len(t.p) * 1.25 UNION ALL SELECT doc_id, line, license, template, 2 * c / (n + size) FROM e)
SELECT doc_id, count(DISTINCT (line, template)) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines, max(dice) AS best FROM m WHERE dice >= {license_scan.DICE} GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    """SQL can say these; the others are held against brute force, the tokenizers' libraries or held-out rows in tests/llm."""
    return {"op2_license_scan": _license_sql(), "op3_decontamination": DECONTAMINATION_SQL, "op7_near_dup": NEAR_DUP_SQL, "op11_warc": WARC_SQL, "op12_vector_codes": _codes_sql(), "op13_divergence": DIVERGENCE_SQL}
