"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm import language, licenses, media, mixing, packing, periodic, permutation, phrases, pii, secrets, simhash, token_count, vectors
from clausemill.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=mixing.KEEP, carry=["doc_id", "source", "lang"])
    rounded = [F.round(f"__{c}", 9).alias(c) for c in ("probability", "residual")]
    return mixed.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").cast("bigint").alias("n_tokens"), *rounded, F.col("__sampled").alias("sampled"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(table(spark, sf_dir, "embeddings"))


def _planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; in the tenth of documents that the hash of the id picks, the words from one place on repeat a few words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    base = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words))
    base = base.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    base = base.withColumn("a", F.col("g") % F.when(F.col("n") > 0, F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int((n - a) div p) + 1)), 1, int(n - a)))")
    return base.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic.periodic_runs(_planted(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    best = runs.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"), F.expr("(-1000 * b.l) div b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_simhash, op2_secrets, op3_mixing, op4_licenses, op5_token_counts, op6_packing, op7_pii, op8_media, op9_top_k, op10_language, op11_neighbours, op12_periodic, op13_phrases)
    return {f.__name__: f for f in every}


def _mixing_sql() -> str:
    """The sweeps unrolled; shares, sums, the end of the sweeps, the scale and the draws as in ``mixing``.

    The scale holds the k cells of the highest rates at 1, for the smallest k that leaves all others under 1.
    """
    steps, now, dims = [], "start", list(mixing.POWERS)
    for i in range(mixing.SWEEPS):
        steps.append(f"s{i} AS (SELECT source, lang, topic, tokens, weight, 0.0::DOUBLE AS off, done OR max(off) OVER () <= {mixing.TOLERANCE} AS done FROM {now})")
        now = f"s{i}"
        for name in dims:
            steps.append(f"""w{i}_{name} AS (SELECT source, lang, topic, tokens, CASE WHEN done THEN weight ELSE weight * f END AS weight, CASE WHEN done THEN off ELSE greatest(off, abs(f - 1)) END AS off, done
  FROM (SELECT c.*, a.target / sum(c.weight) OVER (PARTITION BY c.{name}) AS f FROM {now} c JOIN aim_{name} a USING ({name})))""")
            now = f"w{i}_{name}"
    aims = [f"aim_{n} AS (SELECT {n}, pow(have, {p}) / sum(pow(have, {p})) OVER () AS target FROM (SELECT {n}, sum(tokens) AS have FROM cells GROUP BY {n}))" for n, p in mixing.POWERS.items()]
    without = "t"
    for mark in mixing.MARKS:
        without = f"replace({without}, '{mark}', '')"
    times = lambda strings: " + ".join(f"(length(t) - length(replace(t, '{x}', ''))) / {len(x)}" for x in strings)
    words = "\n".join(f"       WHEN ({times(x)}) * {mixing.DENSITY * 6} > greatest(length(t), 1) THEN '{n}'" for n, x in mixing.TOPICS.items())
    once = lambda xs: ", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in xs)
    misses = ", ".join(f"abs(sum(weight) OVER (PARTITION BY {n}) - aim_{n}.target)" for n in dims)
    return f"""
WITH docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, coalesce(source, '') AS s, coalesce(lang, '') AS l FROM documents),
marked AS MATERIALIZED (SELECT doc_id, source, lang, s, l, len(regexp_extract_all(t, '[^\\x09-\\x0D\\x20]+'))::DOUBLE AS tokens,
  CASE WHEN (length(t) - length(replace(t, ' | ', '  '))) * 40 > greatest(length(t), 1) THEN 'table'
       WHEN (greatest(length(t), 1) - length({without})) * 10 > greatest(length(t), 1) THEN 'noise'
       WHEN t = upper(t) AND t <> lower(t) THEN 'shout'
{words} ELSE 'prose' END AS topic FROM docs),
cells AS MATERIALIZED (SELECT s AS source, l AS lang, topic, sum(tokens) AS tokens FROM marked GROUP BY ALL HAVING sum(tokens) > 0),
{once(aims)},
start AS (SELECT source, lang, topic, tokens, tokens AS weight, 1.0::DOUBLE AS off, false AS done FROM cells),
{once(steps)},
raked AS MATERIALIZED (SELECT source, lang, topic, tokens, weight, weight / tokens AS rate, greatest({misses}) AS residual FROM {now} {' '.join(f'JOIN aim_{n} USING ({n})' for n in dims)}),
scales AS (SELECT rate, k, ({mixing.KEEP} * (SELECT sum(tokens) FROM cells) - held) / rest AS c FROM (
  SELECT rate, row_number() OVER w AS k, sum(tokens) OVER w - tokens AS held, (SELECT sum(weight) FROM raked) - sum(weight) OVER w + weight AS rest FROM raked
  WINDOW w AS (ORDER BY rate DESC, source, lang, topic ROWS UNBOUNDED PRECEDING))),
scale AS (SELECT arg_min(c, k) AS c FROM scales WHERE rate * c < 1),
chances AS (SELECT m.*, residual, CASE WHEN m.tokens > 0 THEN coalesce(least(1.0, r.rate * (SELECT c FROM scale)), 0.0) ELSE 0.0 END AS p FROM marked m LEFT JOIN raked r ON m.s = r.source AND m.l = r.lang AND m.topic = r.topic)
SELECT doc_id, source, lang, topic, tokens::BIGINT AS n_tokens, round(p, 9) AS probability, round(residual, 9) AS residual,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p AS sampled FROM chances"""


_TOP_K_SQL = f"""
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 20"""


#: Phrases of two and three words by list slices; HUGEINT holds the products exactly.
_PHRASES_SQL = f"""
WITH pieces AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
cut AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM cut, (VALUES (1), (2), (3)) AS sizes_of(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
long AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT p.lang, p.phrase, p.k, p.a, p.w, c.place, array_to_string(p.w[1:c.place], ' ') AS lp, array_to_string(p.w[c.place + 1:], ' ') AS rp FROM long p JOIN (VALUES (1), (2)) AS c(place) ON c.place < p.k),
scored AS (SELECT c.lang, c.phrase, c.k, c.a, c.place, fl.a AS l, fr.a AS r, ((1000000::HUGEINT * c.a * c.a) // (fl.a::HUGEINT * fr.a))::BIGINT AS score FROM cuts c
  JOIN f fl ON fl.lang = c.lang AND fl.k = c.place AND fl.phrase = c.lp JOIN f fr ON fr.lang = c.lang AND fr.k = c.k - c.place AND fr.phrase = c.rp),
chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, place) = 1),
within AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM long WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM long WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM chosen c LEFT JOIN within i ON c.k = 2 AND i.lang = c.lang AND i.phrase = c.phrase WHERE i.most IS NULL OR 100 * i.most < {phrases.PART} * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT k.*, n, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept k JOIN sizes USING (lang)) WHERE rank <= {phrases.TOP}"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": _mixing_sql(), "op9_top_k": _TOP_K_SQL, "op13_phrases": _PHRASES_SQL}
