"""The pipeline against its stages run one by one, and what each stage must keep."""

import corpus_pipeline
from clausemill.llm import packing, secrets


def test_stages_keep_columns_and_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    at = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, data)
        assert sorted(at.columns) == sorted(docs.columns), name
        counts.append(at.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > counts[4] > 0
    letters = docs.where(r"text rlike '\\p{L}'").count()
    assert counts[1] == letters
    left = secrets.secret_report(at)
    assert left.where("n_access > 0 or n_hex > 0").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, data)
    assert pieces.select("doc_id").distinct().count() == at.count()


def test_run_equals_its_stages(spark, data):
    at = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, data)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*names).collect())
    assert rows(corpus_pipeline.run(spark, data)) == rows(packing.pack(at))


def test_near_dedup_equals_brute_force(spark, data, monkeypatch):
    """Copies at many degrees of similarity, some linked only through others, against all pairs compared."""
    import random

    from clausemill.llm import overlap

    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    for i, (_, text) in enumerate(rows[:60]):
        for j in range(4):
            words = (text or "").split()[:400]
            for _ in range(max(1, len(words) * j // 100)):
                words[rng.randrange(len(words))] = f"w{rng.random()}"
            rows.append((10_000 + 4 * i + j, " ".join(words)))
    rows += [(20_000, ""), (20_001, None), (20_002, "one"), (20_003, " ONE\n")]
    sets = []
    for i, text in rows:
        words = (text or "").lower().split()
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    sets.sort(key=lambda s: s[0])
    label = list(range(len(sets)))
    near = 0

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and len(x & y) * 5 >= len(x | y) * 4:
                near += 0 < len(x & y) < len(x | y)
                p, q = sorted((root(a), root(b)))
                label[q] = p
    want = [sets[i][0] for i in range(len(sets)) if root(i) == i]
    assert near > 50 and len(want) < len(sets)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(r[0] for r in corpus_pipeline.near_dedup(spark, df, data).select("doc_id").collect()) == want
    monkeypatch.setattr(overlap, "BLOCK", 2)  # every block is dealt into chunks
    assert sorted(r[0] for r in corpus_pipeline.near_dedup(spark, df, data).select("doc_id").collect()) == want


def test_near_dedup_odd_rows(odd_docs, no_docs):
    from clausemill.llm import overlap

    kept = overlap.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and overlap.keep_first(no_docs).count() == 0
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=str) == sorted([0, 2, 5, 6, 7, 8, 10, 11, None], key=str)


def test_source_mix_keeps_its_share_beside_a_tiny_source(spark, data):
    """One document of a new source must not change what others keep."""
    from pyspark.sql import functions as F

    from clausemill.llm import mixing

    docs = spark.read.parquet(f"{data}/documents.parquet")
    tiny = docs.limit(1).withColumns({"doc_id": F.lit(10**9).cast(docs.schema["doc_id"].dataType), "text": F.lit("five words of new source"), "source": F.lit("tiny")})
    tokens = F.size(F.split(F.trim("text"), r"\s+"))
    total, kept = (df.agg(F.sum(tokens)).first()[0] for df in (docs, corpus_pipeline.source_mix(spark, docs.unionByName(tiny), data)))
    assert abs(kept / total - mixing.KEEP) < 0.12
    cells = spark.createDataFrame([(10.0, 1.0), (100.0, 1.0), (1000.0, 1.0)], "tokens double, weight double").withColumn("rate", F.col("weight") / F.col("tokens"))
    for keep in (0.05, 0.4, 0.9, 1.0):
        c = mixing.scale_for(cells, keep)
        assert abs(sum(t * min(1.0, c / t) for t in (10.0, 100.0, 1000.0)) - keep * 1110) < 1e-6


def test_language_stage_without_labels_and_with_unknown_script(spark, data):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(20)
    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    letters = docs.where(r"text rlike '\\p{L}'").count()
    kept = corpus_pipeline.language_id(spark, plain, data)
    assert letters > 0 and kept.count() == letters and kept.where("lang is not null").count() == 0
    nobody = docs.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    assert corpus_pipeline.language_id(spark, nobody, data).count() == letters
    rows = [(i, "the quick brown fox", "en") for i in range(20)] + [(100, "შემოდგომა", None), (101, "შემოდგომა", "ka"), (102, "fox", None), (103, "12", None)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows[:20] + [r for r in rows[20:] if r[0] != 101], "doc_id bigint, text string, lang string"), data)
    assert sorted(r[0] for r in kept.where("doc_id >= 100").select("doc_id").collect()) == [102]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), data)
    assert 101 in {r[0] for r in kept.select("doc_id").collect()}


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    """Ids 3 and 5 with equal texts, a second row 5 with a text of its own, null ids, and equal rows."""
    from clausemill.llm import overlap, simhash

    same, own, other = "one text that two documents share word for word", "a text that no other row here has at all", "the third text stands only on rows without an id"
    rows = [(3, same, 1), (5, same, 2), (5, own, 3), (None, same, 4), (None, other, 5), (None, other, 5), (7, None, 6), (7, None, 7), (8, " \n", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __first int").selectExpr("*", "'x' AS key", "'y' AS doc", "map('a', 1) AS same").repartition(4)
    for keep in (overlap.keep_first, simhash.keep_first):
        kept = keep(df)
        assert kept.columns == df.columns
        assert sorted((r["__first"] for r in kept.collect())) == [1, 3, 5, 6]


def test_blocks_of_files_give_the_same_rows_and_no_text_is_shuffled(spark, data, tmp_path, monkeypatch):
    """Lists of places over many files, cut between and inside files; with thresholds at 0 nothing but a broadcast meets the texts."""
    from pyspark.sql import functions as F

    from clausemill.llm import keep

    base = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"), F.lit("x").alias("file"), F.lit(1).alias("_metadata"))
    base.repartition(7).write.parquet(f"{tmp_path}/many")
    base.coalesce(1).where("doc_id >= 3000").write.mode("append").parquet(f"{tmp_path}/many")
    docs = keep.placed(spark.read.parquet(f"{tmp_path}/many"), stored=True)
    places = keep.keyed(docs, "doc_id", "text").where("key.id % 3 = 0").select("key.file", "key.row")
    odd = sorted(r[0] for r in docs.where("doc_id % 3 = 0").select("doc_id").collect())
    rest = sorted(r[0] for r in docs.where("doc_id % 3 <> 0").select("doc_id").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, blocks in ((10**6, 1), (200, 8), (50, 20)):
            monkeypatch.setattr(keep, "LISTED", most)
            parts = list(keep.sifted(docs, places, "left_anti"))
            assert len(parts) >= blocks and (most == 10**6) == (len(parts) == 1)
            for part in parts:
                plan = part._jdf.queryExecution().executedPlan().toString()
                assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
                assert not [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]
            assert sorted(r[0] for p in parts for r in p.select("doc_id").collect()) == rest
            got = keep.sift(docs, places, "left_semi")
            assert got.columns == docs.columns and sorted(r[0] for r in got.select("doc_id").collect()) == odd
            assert keep.sift(docs, places.limit(0), "left_anti").count() == docs.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_run_leaves_one_table(spark, data, tmp_path, monkeypatch):
    import os

    from clausemill import storage

    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, data).count() and len(os.listdir(tmp_path)) == 1


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, data):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd_docs, data)
        assert got.columns == odd_docs.columns and got.count() <= odd_docs.count(), name
        got = stage(spark, no_docs, data)
        assert got.columns == odd_docs.columns and got.count() == 0, name
    assert corpus_pipeline.pack(spark, no_docs, data).count() == 0


def test_near_dedup_compares_operator_1s_components(spark, data, monkeypatch):
    """The stage made no fingerprints.  Without any band, texts that operator 1 links are still compared."""
    from pyspark.sql import functions as F

    from clausemill.llm import overlap, simhash

    words = [f"word{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "changed"]), "nothing in common with the others", "of its own"]
    every = [(i, overlap._digest(overlap.shingles(t)), simhash.fingerprint(t)) for i, t in enumerate(texts)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    marks = spark.createDataFrame([(signed(s), signed(f)) for _, s, f in every], "same bigint, fp bigint")
    distinct = spark.createDataFrame([(signed(s), i, 1) for i, s, _ in every], "same bigint, first int, size int").withColumn("keys", F.array().cast("array<bigint>"))
    assert overlap._blocks(distinct).count() == 0
    blocks = overlap._blocks(overlap._with_components(distinct, marks, 4))
    assert {r["same"] for r in blocks.collect()} == {signed(s) for _, s, _ in every[:2]} and blocks.select("unit").distinct().count() == 1
    asked = []
    monkeypatch.setattr(overlap, "links", lambda rows, radius: asked.append(radius) or simhash.links(rows, radius))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r[0] for r in corpus_pipeline.near_dedup(spark, df, data).select("doc_id").collect()) == [0, 2, 3] and asked == [4]


def test_stages_take_short_arrow_batches(spark, data):
    """A task and its Python worker held up to 10,000 texts at once; the session's own setting must come back."""
    from clausemill import storage

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(setting)
    found = storage.settle(spark.range(0, 2_000, 1, 1).mapInArrow(sizes, "n bigint"), "sizes")
    assert sorted(r[0] for r in found.collect()) == [storage.ARROW_ROWS] * (2_000 // storage.ARROW_ROWS) and spark.conf.get(setting) == own
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert storage.settled(kept := corpus_pipeline.language_id(spark, docs, data), "again") is kept
    spark.conf.set(setting, "7")  # a user's own bound, if it is lower, holds
    try:
        found = storage.settle(spark.range(0, 14, 1, 1).mapInArrow(sizes, "n bigint"), "sizes")
        assert [r[0] for r in found.collect()] == [7, 7] and spark.conf.get(setting) == "7"
    finally:
        spark.conf.set(setting, own)


def test_near_dedup_starts_no_second_kind_of_python_workers(spark, data, monkeypatch):
    """An empty list as a table ran through RDD workers, which stay beside those of Arrow for a minute."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: 1 / 0)
    assert 0 < corpus_pipeline.near_dedup(spark, docs, data).count() < docs.count()
