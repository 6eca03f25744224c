from collections import Counter

from pyspark.sql import functions as F


def test_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES][0] == "toxicity" and len(P.STAGES) == 5
    before, seen = docs.count(), docs
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, seen, sf)
        assert out.columns == docs.columns
        out = out.cache()
        assert 0 < out.count() <= before
        if k == 3:
            assert out.count() == before  # replacing drops nothing
        before, seen = out.count(), out
    packed = P.STAGES[-1][1](spark, seen, sf)
    assert packed.select("doc_id").distinct().count() == before
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_near_duplicates_keep_one_of_each(spark, sf):
    import corpus_pipeline as P
    from corvane.llm import ngram_join

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = ngram_join.component_table(docs)
    kept = P.drop_near_duplicates(spark, docs, sf)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.component_id for r in table.select("component_id").collect()}


ODD = [
    (9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "there is no id at all here", None, "s", 5), (9003, "many words that differ " + " ".join(f"w{i}" for i in range(40_000)), "en", "s", 1),
    (9004, "a row that comes twice " + " ".join(f"t{i}" for i in range(60)), "en", "s", 1), (9004, "a row that comes twice " + " ".join(f"t{i}" for i in range(60)), "en", "s", 1), (9005, " \n\t ", "de", "s", 1),
    (9006, "Ünïcode 漢字 😀 <|endoftext|> 'tis " + " ".join(f"ü{i}" for i in range(50)), "fr", "s", 1), (9007, "Write to Mr John Smith, john@smith.org, or call +1 555 123 4567. " + " ".join(f"m{i}" for i in range(60)), "en", "s", 1),
]
CLASHING = ("score", "kept", "label", "component_id", "kind", "row", "e", "length", "n_words", "digest")


def _folder(spark, path, docs, labels):
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_on_odd_rows_against_brute_force(spark, sf, tmp_path, request):
    import corpus_pipeline as P
    import public_tokenizers
    from corvane.llm import pii, quality, toxicity
    from test_llm_operators import brute_components, brute_quality
    from tokenizers import Tokenizer

    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    vile = [(8000 + k, " ".join(f"v{k}x{i}" for i in range(40)) + " you vileword " + " ".join(f"z{k}x{i}" for i in range(k)), "en", "s", 1) for k in range(60)]
    docs = real.unionByName(spark.createDataFrame(ODD + vile, real.schema))
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("clash"))
    known = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    known = known.unionByName(spark.createDataFrame([(k, None, 1) for k in range(8000, 8050)], known.schema))
    folder = _folder(spark, tmp_path, docs, known)
    spark.conf.set("spark.corvane.pii.key", "a key for tests")
    request.addfinalizer(lambda: spark.conf.unset("spark.corvane.pii.key"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    seen = spark.read.parquet(f"{folder}/documents.parquet")

    # Documents judged in other, much smaller batches.
    one_by_one = lambda df: df.repartition(97)
    model = toxicity.fit(seen, labels)
    toxic = {r.doc_id for r in toxicity.score_documents(one_by_one(seen), model).filter("predicted = 1").collect()}
    clean = P.reject_toxic(spark, seen, folder)
    assert clean.columns == docs.columns and toxic >= set(range(8000, 8060)) and not toxic & {r[0] for r in ODD}
    assert _rows(clean) == Counter({k: n for k, n in _rows(seen).items() if k[0] not in toxic})

    clean = clean.cache()
    verdicts = quality.fit(clean, labels)
    good = P.reject_low_quality(spark, clean, folder).cache()
    kept = Counter((r.doc_id, r.text) for r in good.collect())
    judged = {(r.doc_id, r.n_words): r.kept for r in quality.judge_documents(one_by_one(clean), verdicts).collect()}
    for r in clean.collect():
        n_words, _, _, _, repeated = brute_quality(r.text)
        base_failed = n_words < 20 or 100 * repeated > 30 * n_words
        assert (kept[(r.doc_id, r.text)] > 0) == (judged[(r.doc_id, n_words)] and not base_failed)
    assert kept[(9004, ODD[4][1])] == 2 and (9003, ODD[3][1]) in kept and (9001, None) not in kept

    single = P.drop_near_duplicates(spark, good, folder).cache()
    want = {low for _, _, low in brute_components(list(dict.fromkeys(kept)))}
    assert Counter(r.doc_id for r in single.collect()) == Counter(want)

    private = P.replace_personal_data(spark, single, folder).cache()
    assert private.columns == docs.columns
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (single, private))
    assert before.keys() == after.keys() and "john@smith.org" not in after[9007] and "John Smith" not in after[9007]
    has = {r.doc_id for r in single.filter(F.col("text").rlike(pii.PATTERN)).collect()}
    assert {k for k in before if before[k] != after[k]} == has

    pieces = P.pack(spark, private, folder).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode_special_tokens = True  # as the vocabulary's notes say
    tokens = {k: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for k, t in after.items()}
    total, places = Counter(), {}
    for r in pieces:
        total[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == tokens
    for spots in places.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:i]) for i in range(len(spots))] and sum(n for _, n in spots) <= 1024


def test_pipeline_of_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert P.run(spark, _folder(spark, tmp_path / "none", docs.limit(0), labels)).count() == 0
    unlabelled = P.run(spark, _folder(spark, tmp_path / "unlabelled", docs.limit(40), labels.limit(0)))
    assert unlabelled.select("doc_id").distinct().count() > 10
    nothing = spark.createDataFrame([(1, None), (None, None), (2, ""), (2, "")], "doc_id bigint, text string")
    assert P.run(spark, _folder(spark, tmp_path / "nulls", nothing, labels)).count() == 0
