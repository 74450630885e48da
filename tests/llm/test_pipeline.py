"""The pipeline's stages, each held against a plain version on what its predecessor kept."""

import random
from collections import Counter

import corpus_pipeline
from namelattice.llm import mixing, queries, toxicity
from namelattice.storage import stored

from .test_operators import plain_classes, plain_windows, plain_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(400):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([30, 40, 80]))]
        if i % 6 == 1:
            words[3] = "worthless"
        docs.append([i, " ".join(words), "en", rng.choice(["a", "a", "a", "b", None]), 0])
        labels.append((i, 1, int(i % 6 == 1)))
    leaked = docs[8][1].split(" ")[4:18]
    docs += [[500 + i, docs[i][1] + (" extra" if i % 2 else ""), "en", "a", 0] for i in range(0, 60, 3)]
    docs += [[600, None, None, None, None], [601, "", "en", "b", 0], [None, "no id here at all, but words", "en", "a", 1], [602, docs[2][1], "de", "b", 0], [602, docs[2][1], "de", "b", 0]]
    spark.createDataFrame([tuple(d) for d in docs], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leaked))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return " ".join(leaked)


def rows(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=repr)


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    leaked = tables(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"] and corpus_pipeline.ORACLE_SQL is None
    stages = dict(corpus_pipeline.STAGES)

    clean = stored(stages["toxicity"](spark, docs, sf), "clean")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rows(clean) == [r for r in rows(docs) if model.score(toxicity.term_ids((r[1] or "").encode())) < 0.5]
    assert all("worthless" not in (r[1] or "") for r in rows(clean)) and len(rows(clean)) > 300

    single = stored(stages["near_duplicates"](spark, clean, sf), "single")
    before = rows(clean)
    worded = [(i, t, s) for i, t, _, s, _ in before if plain_words(t) and i is not None]
    expected = {c for _, c, _ in plain_classes(worded)}
    assert sorted(r[0] for r in rows(single) if r[0] is not None and plain_words(r[1])) == sorted(expected)
    assert {r[0] for r in rows(single) if not plain_words(r[1])} == {600, 601}

    pure = stored(stages["decontamination"](spark, single, sf), "pure")
    assert rows(pure) == [r for r in rows(single) if not plain_windows(plain_words(r[1]), plain_words(leaked))[0]]
    assert 0 < single.count() - pure.count() < 5

    mix = stored(stages["mixing"](spark, pure, sf), "mix")
    copies = Counter()
    for r in mixing.plan(pure).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r[0] for r in rows(mix)) == +copies and mix.columns == docs.columns

    last = stages["token_files"](spark, mix, sf).collect()
    assert Counter(r.doc_id for r in last) == +copies
    assert sum(r.n_tokens for r in last) == max(r.start + r.n_tokens for r in last)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, last))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    sf = str(tmp_path)
    schema = SCHEMA + ", h string, key long, doc string, row int, t string, size int"
    spark.createDataFrame([], schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 1, "h", 2, "doc", 3, "t", 4), (None, None, None, None, None, None, None, None, None, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
