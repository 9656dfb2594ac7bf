"""Queries over the driver's tables, one for each operator of this subpackage: whole tables, whole texts, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import fit_language_model, held_out, predict_language

    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.filter(~held_out(F.col("doc_id"))))
    found = predict_language(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents"), 8)
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint")
    return out.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, r.last IS NOT NULL AND k.doc_id < r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    listed = lambda c: F.array_join(F.transform("takes", lambda t: t[c].cast("string")), ",")
    taken = (F.size("takes") * F.col("size")).cast("bigint").alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken, listed("shard").alias("shards"), listed("place").alias("places"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngram_join import join_components

    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN c p ON p.doc_id = x JOIN c q ON q.doc_id = y WHERE 100 * o.n >= 80 * (p.n + q.n - o.n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN c ON d.doc_id = c.doc_id JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) m ON d.doc_id = m.doc_id
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import known_digests, scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), known_digests(spark))
    return out.select("doc_id", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"))


def op9_sql() -> str:
    from tidemark.llm.license_digests import TEXTS
    from tidemark.llm.license_texts import short_texts
    from tidemark.llm.licenses import COPYRIGHT_LINE, HEAD, NOTICES, SPELLINGS

    def respelled(x: str) -> str:
        x = f"lower({x})"
        for pattern, new in SPELLINGS:
            x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
        return x

    def plain(x: str) -> str:
        return rf"trim(regexp_replace({x}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ')"

    def canonical(x: str) -> str:
        kept = rf"list_filter(string_split({respelled(x)}, chr(10)), lambda l: NOT regexp_matches(l, '{COPYRIGHT_LINE}'))"
        return f"md5({plain(f'coalesce(array_to_string({kept}, chr(10)), {chr(39) * 2})')})"

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    texts = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in [*NOTICES, *short_texts()])
    long = ", ".join(f"({quote(a)}, {n}, {quote(h)}, {quote(d)})" for a, n, h, d in TEXTS)
    own = canonical("text").removeprefix("md5(").removesuffix(")")
    return f"""
WITH n(license, text) AS (VALUES {texts}), c AS (SELECT license, {own} AS t FROM n),
known AS (SELECT digest, min(license) AS license, any_value(words) AS words, any_value(head) AS head FROM
 (SELECT license, len(string_split(t, ' ')) AS words, array_to_string(string_split(t, ' ')[1:{HEAD}], ' ') AS head, md5(t) AS digest FROM c UNION ALL SELECT * FROM (VALUES {long}) AS x(license, words, head, digest)) GROUP BY digest),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split({respelled("coalesce(text, '')")}, chr(10)) AS ls FROM documents)),
p AS (SELECT doc_id, i, {plain('line')} AS t, regexp_matches(line, '{COPYRIGHT_LINE}') AS owner FROM l),
v AS (SELECT doc_id, side, t, row_number() OVER w AS j, sum(len(string_split(t, ' '))) OVER w AS upto FROM p, (SELECT unnest([0, 1]) AS side) WHERE t <> '' AND NOT (side = 1 AND owner) WINDOW w AS (PARTITION BY doc_id, side ORDER BY i)),
s AS (SELECT doc_id, side, j, upto - len(string_split(t, ' ')) + words AS until, words, license, digest FROM v JOIN (SELECT * FROM known WHERE words > 0) k ON string_split(t, ' ')[1] = string_split(k.head, ' ')[1]),
r AS (SELECT s.*, e.j AS last FROM s JOIN v e ON s.doc_id = e.doc_id AND s.side = e.side AND s.until = e.upto AND e.j >= s.j),
g AS (SELECT r.doc_id, r.license, r.digest, md5(string_agg(m.t, ' ' ORDER BY m.j)) AS own FROM r JOIN v m ON r.doc_id = m.doc_id AND r.side = m.side AND m.j BETWEEN r.j AND r.last GROUP BY r.doc_id, r.side, r.j, r.last, r.license, r.digest),
f AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM g WHERE own = digest GROUP BY 1)
SELECT d.doc_id, d.digest, known.license, coalesce(f.line_licenses, '') AS line_licenses
FROM (SELECT doc_id, {canonical("coalesce(text, '')")} AS digest FROM documents) d LEFT JOIN known ON d.digest = known.digest LEFT JOIN f ON d.doc_id = f.doc_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality

    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_lost", F.sha2("cleaned", 256).alias("cleaned_sha256"))


def op10_sql() -> str:
    from tidemark.llm.quality import BOILERPLATE, ENDS, FURNITURE, MOST_LOST, SEPARATORS, SHORT, SYMBOLS

    def count(x: str, chars: str) -> str:
        return f"(length({x}) - length(translate({x}, '{chars}', '')))"

    ends = ENDS.replace("'", "''")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
l0 AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l0),
l AS (SELECT *, n > 0 AND ((n < {SHORT} AND NOT regexp_matches(line, '{ends}')) OR (n >= 3 AND {count('line', '!?')} > n) OR (n >= 3 AND {count('line', SYMBOLS)} * 2 > n)
  OR ({count('line', SEPARATORS)} >= 2 AND {count('line', SEPARATORS)} * 3 > n)
  OR (n <= {FURNITURE} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BOILERPLATE}'))) AS fails FROM l1),
s AS (SELECT doc_id, count(line) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT fails), '') AS cleaned FROM l GROUP BY 1),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({count('text', SYMBOLS)} AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(lost AS BIGINT) AS n_words_lost, cleaned FROM d JOIN s ON d.doc_id = s.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words_lost * 100 <= n_words * {MOST_LOST} AS kept, n_words_lost, sha256(cleaned) AS cleaned_sha256 FROM f
"""


def crc_sql(text: str, table: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes; its code points are below 0x800. table: a list that holds CRC_TABLE."""
    code = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN [] WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {code})::BIGINT[], lambda c, b: xor(c >> 8, {table}[CAST(xor(c & 255, b) AS INTEGER) + 1])))"


def _crc_table() -> list[int]:
    """The remainders of each byte by the polynomial of crc32."""
    out = list(range(256))
    for _ in range(8):
        out = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


CRC_TABLE = f"CAST({_crc_table()} AS BIGINT[])"


def with_planted_typos(docs: DataFrame, least: int) -> DataFrame:
    """word: each run of Latin letters of docs (doc_id, text), `least` of them at least, A-Z lower-cased; one in 199, by the crc32 of
    doc_id and run, lacks a code point."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"([A-Za-z\u00C0-\u00FF]{{{least},}})"), 1)).alias("run"))
    runs = runs.select("doc_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spelling import LEAST_LENGTH, counted_words, spelling_groups

    return spelling_groups(counted_words(with_planted_typos(table(spark, sf_dir, "documents"), LEAST_LENGTH)))


#: Numbers that may be null are HUGEINT in the SQL: DuckDB's data frames then hold them as Spark's do.
OP11_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
u AS (SELECT r, h % length(r) AS pos, h % 199 = 0 AS typo, k FROM (SELECT r, k, {crc_sql("doc_id || ':' || r", "crc")} AS h FROM (SELECT doc_id, r, count(*) AS k FROM r WHERE length(r) >= 6 GROUP BY ALL), (SELECT {CRC_TABLE} AS crc))),
v AS (SELECT w, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN typo THEN substr(r, 1, pos) || substr(r, pos + 2) ELSE r END AS w, k FROM u) WHERE length(w) >= 6 GROUP BY w HAVING sum(k) >= 5),
d AS (SELECT w, n, i, substr(w, 1, i) || substr(w, i + 2) AS d FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
p AS (SELECT DISTINCT * FROM (SELECT x.w, y.w AS near, y.n AS near_n FROM d x JOIN d y ON x.d = y.d AND x.i = y.i AND length(x.w) = length(y.w) AND x.w <> y.w
  UNION ALL SELECT x.w, v.w, v.n FROM d x JOIN v ON x.d = v.w UNION ALL SELECT v.w, x.w, x.n FROM d x JOIN v ON x.d = v.w)),
b AS (SELECT w, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY w),
f AS (SELECT v.w AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN b ON v.w = b.w),
c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, CAST(f.form_n AS HUGEINT) AS form_n FROM f JOIN c ON f.word = c.word JOIN f l ON c.root = l.word AND l.form IS NULL
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; where crc32 of the decimal doc_id ends in 0, the words from some place on repeat a stretch of theirs."""
    from tidemark.llm.common import words_of

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    copied = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(copied, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.periodic_runs import find_runs

    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")), columns=["doc_id"])
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])  # noqa: E731  runs ascend by start, then period
    found = found.withColumn("best", F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(better(a, r), r).otherwise(a)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n", "")
    digest = F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256)
    milli = F.expr("best.length * 1000 div best.period")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc_sql("CAST(doc_id AS VARCHAR)", "crc")} AS h FROM documents, (SELECT {CRC_TABLE} AS crc)),
e AS (SELECT doc_id, w, h // 10 AS g, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) END AS w FROM e),
k AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 16], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 15)) AS i FROM f WHERE len(w) >= 24)),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
r AS (SELECT doc_id, q, min(i) AS s, max(i) + 16 - min(i) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
u AS (SELECT doc_id, s, l, min(q) AS q FROM r WHERE l >= 24 AND l >= 3 * q GROUP BY ALL),
b AS (SELECT doc_id, s, l, q FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM u GROUP BY 1),
c AS (SELECT doc_id, sum(d) AS d, i FROM (SELECT doc_id, s + q AS i, 1 AS d FROM u UNION ALL SELECT doc_id, s + l, -1 FROM u) GROUP BY doc_id, i),
x AS (SELECT doc_id, i, sum(d) OVER (PARTITION BY doc_id ORDER BY i) AS held, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM c),
y AS (SELECT doc_id, list({{'a': i, 'b': upto}}) AS gone FROM x WHERE held > 0 GROUP BY 1),
z AS (SELECT f.doc_id, array_to_string(list_filter(w, lambda v, i: gone IS NULL OR len(list_filter(gone, lambda o: i - 1 >= o.a AND i - 1 < o.b)) = 0), ' ') AS kept FROM f LEFT JOIN y ON f.doc_id = y.doc_id)
SELECT z.doc_id, coalesce(t.n, 0) AS n_runs, CAST(b.s AS HUGEINT) AS start, CAST(b.l AS HUGEINT) AS length, CAST(b.q AS HUGEINT) AS period, CAST(1000 * b.l // b.q AS HUGEINT) AS exponent_milli, sha256(coalesce(t.listed, '')) AS runs_sha256, sha256(kept) AS collapsed_sha256
FROM z LEFT JOIN t ON z.doc_id = t.doc_id LEFT JOIN b ON z.doc_id = b.doc_id
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import exact_groups

    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_ngram_join": op8_ngram_join,
    "op9_license_scan": op9_license_scan,
    "op10_quality": op10_quality,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_ngram_join": OP8_SQL,
    "op9_license_scan": op9_sql(),
    "op10_quality": op10_sql(),
    "op11_spelling_groups": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
