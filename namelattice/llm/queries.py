"""The queries of the training-data operators and, where SQL has them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bagminhash, decontam, fill_middle, language_id, licenses, line_dedup, mixing, quality, token_counts, token_orc, toxicity, variants, vector_dedup
from .labelled import id_remainder

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9::DOUBLE),
reach(x, y) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def _classified(scored: DataFrame, modulus: int, held_out: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return _classified(quality.score_texts(docs, model), quality.MODULUS, quality.HELD_OUT, quality.THRESHOLD)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return _classified(toxicity.score_texts(docs, model), toxicity.MODULUS, toxicity.HELD_OUT, toxicity.THRESHOLD)


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_file_rows(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '~') AS sk, coalesce(text, '') AS t,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[!#$%&*|<>{}~^=+@\\]')) AS marks FROM documents),
k AS (
  SELECT doc_id, sk, size, -ln((CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || t), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
    / greatest(0.05::DOUBLE, 1.0::DOUBLE - CAST(marks AS DOUBLE) / greatest(size, 1)) AS key FROM d),
s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS INT)] AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM w),
g AS (SELECT sk, source_size, least(cap, max(step) OVER () * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
r AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY sk ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e USING (sk))
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH o AS (
  SELECT doc_id, pos, trim(regexp_replace(raw, '[ \t\r\x0B\x0C]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(range(0, len(p))) AS pos, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
l AS (SELECT * FROM o WHERE line <> ''),
f AS (SELECT line, string_split(line, ' ') AS w, min((doc_id, pos)) AS first FROM l GROUP BY 1),
v AS (SELECT line, first, i, array_to_string(w[:i - 1] || w[i + 1:], ' ') AS v
  FROM (SELECT line, first, w, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 5)),
near AS (
  SELECT a.line FROM v a JOIN v b ON a.v = b.v AND a.i = b.i WHERE b.first < a.first
  UNION SELECT a.line FROM v a JOIN f b ON a.v = b.line AND len(b.w) >= 5 WHERE b.first < a.first
  UNION SELECT b.line FROM v a JOIN f b ON a.v = b.line AND len(b.w) >= 5 WHERE a.first < b.first),
s AS (SELECT l.doc_id, l.pos, CASE WHEN (l.doc_id, l.pos) <> f.first THEN 1 WHEN near.line IS NOT NULL THEN 2 ELSE 0 END AS state
  FROM l JOIN f USING (line) LEFT JOIN near USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (state = 1) AS n_exact, count(*) FILTER (state = 2) AS n_near,
  string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (state = 0) AS kept FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(kept, '') AS kept_lines
FROM documents LEFT JOIN g USING (doc_id)
"""


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k, count(*) AS c
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common / (x.n + y.n - common) >= 0.8),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, two.b FROM reach r JOIN two ON two.a = r.y),
c AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.match_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bwin),
dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM dwin d JOIN bwin b ON d.n = b.n AND d.k = b.k),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1),
dpos AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS w FROM dw WHERE len(w) > 0),
cnt AS (SELECT w, count(*) AS n FROM dpos GROUP BY 1),
wins AS (SELECT k, row_number() OVER () AS win FROM (SELECT DISTINCT k FROM bwin)),
ww AS (SELECT DISTINCT win, w FROM (SELECT win, unnest(string_split(k, ' ')) AS w FROM wins)),
need AS (SELECT win, count(*) AS m, min_by(w, (coalesce(cnt.n, 0), w)) AS rare FROM ww LEFT JOIN cnt USING (w) GROUP BY 1 HAVING min(coalesce(cnt.n, 0)) > 0),
spot AS (SELECT need.win, m, doc_id, p FROM need JOIN dpos ON dpos.w = need.rare),
met AS (SELECT win, doc_id, spot.p FROM spot JOIN ww USING (win) JOIN dpos d USING (doc_id, w) WHERE abs(d.p - spot.p) <= 20 GROUP BY win, doc_id, spot.p, m HAVING count(DISTINCT w) = m),
near_items AS (SELECT doc_id, count(DISTINCT coalesce(CAST(item_id AS VARCHAR), '')) AS n_near FROM (SELECT DISTINCT win, doc_id FROM met) JOIN wins USING (win) JOIN bwin USING (k) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_marked(text: str) -> str:
    """The canonical form with a line break before each line's first word."""
    bare = f"replace(regexp_replace(lower({text}), {_sql_text('(?m)' + licenses.COPYRIGHT_LINE)}, ' ', 'g'), '&', ' and ')"
    bare = rf"regexp_replace(regexp_replace({bare}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' *\n[ \n]*', ' ' || chr(10), 'g')"
    bare = rf"regexp_replace({bare}, '^[ \n]+|[ \n]+$', '', 'g')"
    listed = ", ".join(map(_sql_text, licenses.SPELLINGS))
    forms = "MAP {" + ", ".join(f"{_sql_text(a)}: {_sql_text(b)}" for a, b in licenses.SPELLINGS.items()) + "}"
    word = f"CASE WHEN replace(w, chr(10), '') IN ({listed}) THEN CASE WHEN starts_with(w, chr(10)) THEN chr(10) ELSE '' END || {forms}[replace(w, chr(10), '')] ELSE w END"
    return f"array_to_string(list_transform(string_split(chr(10) || {bare}, ' '), lambda w: {word}), ' ')"


def _op9_sql() -> str:
    known = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, texts in licenses.KNOWN.items() for text in texts)
    return f"""
WITH known AS (SELECT replace({_sql_marked('text')}, chr(10), '') AS c, min(license) AS license FROM (VALUES {known}) v(license, text) GROUP BY 1),
kn AS (SELECT c, license, len(string_split(c, ' ')) AS n, string_split(c, ' ')[1] AS first FROM known WHERE c <> ''),
b AS (SELECT doc_id, text, string_split({_sql_marked('text')}, ' ') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, text, w, i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM b) WHERE starts_with(w[i], chr(10))),
m AS (SELECT doc_id, text, i, i + n AS stop, i = 1 AND n = len(w) AS whole, license FROM s JOIN kn ON replace(w[i], chr(10), '') = first
  WHERE i + n - 1 <= len(w) AND (i + n - 1 = len(w) OR starts_with(w[i + n], chr(10))) AND replace(array_to_string(w[i:i + n - 1], ' '), chr(10), '') = c),
r AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, text ORDER BY i, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
a AS (SELECT doc_id, text, max(license) FILTER (whole) AS whole_license, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM r WHERE reach IS NULL OR reach < stop GROUP BY 1, 2)
SELECT d.doc_id, whole_license, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN a ON d.doc_id IS NOT DISTINCT FROM a.doc_id AND d.text = a.text
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict_texts(docs, language_id.train(docs))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), language_id.MODULUS) == language_id.HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
g AS (SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS x, count(*) AS c FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
  lambda s, b: xor(s >> 8, t[1 + xor(s, b) % 256])), 4294967295) AS h FROM g, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, c FROM h),
n AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM n)),
near AS (
  SELECT a.word AS a, b.word AS b FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM v a JOIN n b ON a.v = b.word
  UNION SELECT b.word, a.word FROM v a JOIN n b ON a.v = b.word),
m AS (SELECT a AS word, count(*) AS n_near, min((-n, b)) AS best FROM near JOIN n ON n.word = b GROUP BY 1),
f AS (SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * n.n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * n.n THEN -best[1] END AS form_n FROM n LEFT JOIN m USING (word)),
c(word, last, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM f JOIN (SELECT word, max_by(last, step) AS root FROM c GROUP BY 1) USING (word)
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
r AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_vector_dedup": op1_vector_dedup,
        "op2_quality": op2_quality,
        "op4_mixing": op4_mixing,
        "op5_line_dedup": op5_line_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_bagminhash": op7_bagminhash,
        "op8_decontam": op8_decontam,
        "op3_token_orc": op3_token_orc,
        "op9_licenses": op9_licenses,
        "op10_token_counts": op10_token_counts,
        "op11_language_id": op11_language_id,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_vector_dedup": OP1_SQL,
        "op4_mixing": OP4_SQL,
        "op5_line_dedup": OP5_SQL,
        "op9_licenses": _op9_sql(),
        "op7_bagminhash": OP7_SQL,
        "op8_decontam": OP8_SQL,
        "op12_spelling_variants": OP12_SQL,
        "op13_fill_middle": OP13_SQL,
    }
