"""One query per operator: the thin query derives its columns from the operator's outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from reelframe.llm import licenses, lm_scores, merkle, mixing, ngram_join, nndescent, personal, pieces, quality_rules, separators, spelling, token_files, toxicity
from reelframe.llm.registry import QUERIES, query, table  # noqa: F401

# Words of a text as DuckDB lists, and the counts of the quality rules.
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
g AS (SELECT row_number() OVER () AS rid, * FROM d),
tri AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM g)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n_repeat FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM g),
f AS (SELECT g.rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
      FROM g JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             n_symbols / n_words::DOUBLE AS m1, word_chars / n_words::DOUBLE AS m2,
             n_dup_lines / n_words::DOUBLE AS m3, n_repeat_words / n_words::DOUBLE AS m4 FROM f),
ok AS (SELECT * FROM b WHERE NOT base_failed),
q AS (SELECT lang, source, grouping(source) + 2 * grouping(lang) AS level, count(*) AS n,
             {", ".join(f"quantile_disc(m{i}, {x}) AS q{i}_{int(100 * x)}" for i in (1, 2, 3, 4) for x in (0.25, 0.5, 0.75))}
      FROM ok GROUP BY GROUPING SETS ((lang, source), (lang), ())),
pick AS (SELECT a.lang, a.source, CASE WHEN a.n >= 100 THEN 0 WHEN l.n >= 100 THEN 1 ELSE 3 END AS level
         FROM q a JOIN q l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM a.lang WHERE a.level = 0),
t AS (SELECT pick.lang, pick.source,
             {", ".join(f"q{i}_50 + 4.0 * greatest(q{i}_50 - q{i}_25, {fl}) AS hi{i}" for i, fl in ((1, 0.05), (2, 0.5), (3, 0.15), (4, 0.15)))},
             q2_50 - 4.0 * greatest(q2_75 - q2_50, 0.5) AS lo2
      FROM pick JOIN q ON q.level = pick.level AND (pick.level = 3 OR q.lang IS NOT DISTINCT FROM pick.lang)
                      AND (pick.level > 0 OR q.source IS NOT DISTINCT FROM pick.source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND m1 <= hi1 AND m2 <= hi2 AND m2 >= lo2 AND m3 <= hi3 AND m4 <= hi4 AS kept
FROM b LEFT JOIN t ON t.lang IS NOT DISTINCT FROM b.lang AND t.source IS NOT DISTINCT FROM b.source
"""


@query("op9_quality_rules", QUALITY_SQL)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_rules.judge(docs, keep=("doc_id",))
    return judged.select(
        "q_row.doc_id", *(F.col(f"q_{f}").alias(f) for f in quality_rules.FEATURES), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept")
    )


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size,
                  ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS u
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
             sum(3 * source_size) OVER o - 3 * source_size AS cap_before,
             sum(w) OVER () - sum(w) OVER o + w AS w_left
      FROM s WINDOW o AS (ORDER BY 3 * source_size / w::DOUBLE, w, source ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT max((total - cap_before) / w_left::DOUBLE) AS level FROM r),
p AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN cap::DOUBLE ELSE w * level END AS target FROM r, lv),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM p),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY u, size ROWS UNBOUNDED PRECEDING) - size / 2 AS mid FROM d)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN mid <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN q ON q.source IS NOT DISTINCT FROM c.source
"""


@query("op4_source_mixing", MIX_SQL)
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, keep=("doc_id",))
    return mixed.select("m_row.doc_id", *(F.col(f"m_{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, doc_id, w[i:i + least(3, len(w)) - 1] AS s
      FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(na.n) AS nx, any_value(nb.n) AS ny
      FROM g a JOIN g b ON a.s = b.s AND a.rid <> b.rid JOIN n na ON na.rid = a.rid JOIN n nb ON nb.rid = b.rid
      GROUP BY a.rid, b.rid, a.doc_id, b.doc_id),
l AS (SELECT DISTINCT x, y FROM p WHERE 100 * shared >= 90 * (nx + ny - shared)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN (SELECT x, min(y) AS low FROM r GROUP BY x) m ON m.x = d.doc_id
"""


@query("op3_ngram_join", NEAR_SQL)
def op3(spark, sf_dir):
    return ngram_join.linked_components(table(spark, sf_dir, "documents"), n=3, percent=90)


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences"
    )


@query("op2_token_counts", "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_tokens FROM documents")
def op2(spark, sf_dir):
    folder = token_files.new_folder(spark, "flat-tokens")
    separators.write_flat_files(table(spark, sf_dir, "documents"), folder)
    files = spark.read.parquet(folder)
    return separators.named(separators.count_tokens(files), files).where("complete").select("doc_id", "n_tokens")


@query("op6_sentencepiece")
def op6(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


@query("op10_token_files")
def op10(spark, sf_dir):
    folder = token_files.new_folder(spark, "token-files")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    token_files.write_token_files(table(spark, sf_dir, "documents"), definition, folder, vocabulary=50257, end_id=0)
    return token_files.read_documents(spark, folder)


NEAREST_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id,
             sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d) WHERE rank <= 10
"""


@query("op7_nndescent", NEAREST_SQL)
def op7(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nndescent.nearest(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").cast("long").alias("query_id")))


LICENSE_SQL = """
WITH t AS (SELECT * FROM (VALUES {notices}) AS v(notice, wording)),
tw AS (SELECT notice, regexp_extract_all(lower(wording), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
ts AS (SELECT DISTINCT notice, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT notice, w, unnest(range(1, len(w) - 1)) AS i FROM tw)),
tn AS (SELECT notice, count(*) AS n, CASE WHEN count(*) <= 9 THEN 8 WHEN count(*) <= 17 THEN 16 WHEN count(*) <= 33 THEN 32 ELSE 64 END AS stride
       FROM ts GROUP BY notice),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
ds AS (SELECT rid, doc_id, i - 1 AS p, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
hit AS (SELECT doc_id, notice, n, stride, s, p // stride - k AS win FROM ds JOIN ts USING (s) JOIN tn USING (notice), (SELECT unnest([0, 1]) AS k)),
share AS (SELECT doc_id, notice, win * stride AS start, count(DISTINCT s) / n::DOUBLE AS share FROM hit WHERE win >= 0
          GROUP BY doc_id, notice, n, stride, win)
SELECT doc_id, notice, max(share) AS contained, min(start)::BIGINT AS first_word FROM share WHERE share >= 0.8 GROUP BY doc_id, notice
""".format(notices=", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.NOTICES.items()))


@query("op8_license_scan", LICENSE_SQL)
def op8(spark, sf_dir):
    return licenses.find_notices(table(spark, sf_dir, "documents"))


LM_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT b, count(*) AS c FROM p GROUP BY b),
c2 AS (SELECT a, b, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY a, b HAVING count(*) >= 2),
t AS (SELECT count(*) AS total FROM p),
s AS (SELECT p.doc_id, CASE WHEN c2.c IS NOT NULL THEN c2.c / f.c::DOUBLE
                            ELSE (CASE WHEN p.a IS NULL THEN 1.0 ELSE 0.4 END)::DOUBLE * g.c / total END AS chance
      FROM p JOIN c1 g ON g.b = p.b LEFT JOIN c1 f ON f.b = p.a LEFT JOIN c2 ON c2.a = p.a AND c2.b = p.b, t)
SELECT d.doc_id, count(chance)::BIGINT AS n_words, round(coalesce(sum(ln(chance)), 0.0), 4) + 0.0 AS score
FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN s ON s.doc_id IS NOT DISTINCT FROM d.doc_id GROUP BY d.doc_id
"""


@query("op1_lm_scores", LM_SQL)
def op1(spark, sf_dir):
    scored = lm_scores.score(table(spark, sf_dir, "documents"))
    return scored.withColumn("score", F.round("score", 4) + F.lit(0.0))


# CRC-32 of a list of bytes; ``crc`` holds its table.
CRC_TABLE_SQL = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32_sql(bytes_sql: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_sql}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


MERKLE_LEVELS = 9  # 8 ** 9 rows a tree


def _merkle_sql() -> str:
    """Levels are unrolled: ``k``-th nodes of each tree, then the proof and the folded digest of each leaf."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    row = lambda text: " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    decimal = "list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)"
    parts = [
        CRC_TABLE_SQL,
        f"""d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({row("text")}) AS leaf,
             CASE WHEN {crc32_sql(decimal)} % 3 = 0 THEN sha256({row(lower)}) END AS changed FROM documents, crc)""",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
    ]
    step = lambda src, k: [
        f"""{src}{k + 1} AS (SELECT tree, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, pos // 8 AS pos
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {src}{k}) GROUP BY tree, n, pos // 8)"""
    ]
    parts.append("n0 AS (SELECT tree, leaf AS h, pos FROM l0)")
    for k in range(MERKLE_LEVELS):
        parts += step("n", k)
    parts.append(f"t0 AS (SELECT '' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n{MERKLE_LEVELS})")
    parts.append(f"names AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n{MERKLE_LEVELS})")
    for k in range(MERKLE_LEVELS):
        parts += step("t", k)
    fold = "SELECT p.doc_id, p.tree, p.leaf, p.start, p.at // 8 AS at, p.{keep} AS {keep}, coalesce(p.proof, '') || coalesce(s.l, '') || coalesce(s.r, '') AS proof, CASE WHEN s.n = 1 THEN p.fold ELSE sha256(coalesce(s.l, '') || p.fold || coalesce(s.r, '')) END AS fold, p.id FROM {p} p JOIN {s} s ON {on}"
    sides = """{out} AS (SELECT a.tree, a.pos, any_value(a.n) AS n, string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos) AS l,
            string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos) AS r
        FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {src}) a JOIN {src} b ON a.tree = b.tree AND a.pos // 8 = b.pos // 8 GROUP BY a.tree, a.pos)"""
    parts.append("p0 AS (SELECT doc_id, tree, leaf, leaf AS start, pos AS at, tree AS grp, '' AS proof, coalesce(changed, leaf) AS fold, row_number() OVER () AS id FROM l0)")
    for k in range(MERKLE_LEVELS):
        parts.append(sides.format(out=f"s{k}", src=f"n{k}"))
        parts.append(f"p{k + 1} AS ({fold.format(keep='grp', p=f'p{k}', s=f's{k}', on='p.grp = s.tree AND p.at = s.pos')})")
    parts.append(f"q0 AS (SELECT p.doc_id, p.tree, p.leaf, p.start, names.pos AS at, p.grp, p.proof, p.fold, p.id FROM p{MERKLE_LEVELS} p JOIN names USING (tree))")
    for k in range(MERKLE_LEVELS):
        parts.append(sides.format(out=f"u{k}", src=f"t{k}"))
        parts.append(f"q{k + 1} AS ({fold.format(keep='grp', p=f'q{k}', s=f'u{k}', on='p.at = s.pos')})")
    last = MERKLE_LEVELS
    return "WITH " + ",\n".join(parts) + f"""
SELECT q.doc_id, q.leaf, names.h AS subroot, t{last}.h AS root, sha256(q.proof) AS proof_sha256, q.fold AS folded_root, q.fold = t{last}.h AS verified
FROM q{last} q JOIN names USING (tree), t{last}"""


@query("op13_merkle_manifest", _merkle_sql())
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    upper = "".join(map(chr, range(65, 91)))
    proven = merkle.manifest(
        docs,
        changed={"text": F.translate("text", upper, upper.lower())},
        when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
    )
    return proven.drop("pos")


SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, sum(k)::BIGINT AS k
         FROM (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY ALL)
         GROUP BY ALL),
codes AS (SELECT *, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch: ord(ch)::BIGINT) AS c FROM runs),
h AS (SELECT run, k, {crc32_sql("flatten(list_transform(c, lambda o: CASE WHEN o < 128 THEN [o] ELSE [192 + (o >> 6), 128 + (o & 63)] END))")} AS h FROM codes, crc),
s AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n, length(word) AS len FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM w)),
near AS (SELECT a.word AS x, b.word AS y, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT x, count(*) AS n_near, max(n) AS top FROM near GROUP BY x),
pick AS (SELECT x, n_near, top, min(y) AS form FROM best JOIN near USING (x) WHERE near.n = top GROUP BY ALL),
j AS (SELECT word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * w.n THEN form END AS form,
             CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN pick ON x = word),
r AS (SELECT word, word AS root, form AS ahead FROM j UNION ALL SELECT r.word, j.word, j.form FROM r JOIN j ON j.word = r.ahead)
SELECT j.word, j.form, r.root, j.n, j.n_near, j.form_n FROM j JOIN r ON r.word = j.word AND r.ahead IS NULL
"""


@query("op11_spelling_variants", SPELLING_SQL)
def op11(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op12_personal_data")
def op12(spark, sf_dir):
    rows, _ = personal.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(personal.of_kind(base, k)).cast("long").alias(f"n_{k}") for k in personal.KINDS]
    return rows.select("kept.doc_id", *counts, F.sha2(personal.span_text(base), 256).alias("base_sha256"), personal.span_text(F.col("spans")).alias("spans"))
