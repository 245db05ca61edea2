"""The pipeline against the brute-force operators, stage by stage and as a whole."""

import brute
import fixtures
import harness
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tillroll.llm import quality_rules


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with the hard cases and benchmark passages among enough clean prose."""
    import random

    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("corpus"))
    clean = [(1000 + i, fixtures.prose(rng, 90)) for i in range(60)]
    clean += [(2000 + i, clean[i][1] + " tail") for i in range(5)]  # near copies
    clean += [(3000 + i, clean[i][1]) for i in range(5, 9)]  # exact copies
    leak = fixtures.prose(rng, 30)
    clean += [(4000 + i, f"{fixtures.prose(rng, 60)}\n{leak}") for i in range(3)]
    rows = fixtures.rows() + clean
    docs = fixtures.documents(spark, rows, extra=False).withColumn("n_chars", F.char_length("text").cast("long"))
    docs.write.parquet(f"{path}/documents.parquet")
    items = [("q1", leak), ("q2", "never seen words here")]
    spark.createDataFrame(items, "item_id STRING, text STRING").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    left = dict(rows)

    # no line is above the limits of a host here, so the base rule decides
    kept = quality_rules.quality_rules(docs)
    assert kept.where("kept = base_failed").count() == 0
    docs = corpus_pipeline.STAGES[0][1](spark, docs, path).persist()
    left = {d: t for d, t in left.items() if not brute.op4_base(t)[5]}
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == left

    docs = corpus_pipeline.STAGES[1][1](spark, docs, path).persist()
    sha = {d: v[2] for d, v in brute.op3(left.items()).items()}
    got = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == columns and {d: brute.sha(r["text"]) for d, r in got.items()} == sha
    assert all(len(r["text"]) == r["n_chars"] for r in got.values())
    left = {d: r["text"] for d, r in got.items()}

    docs = corpus_pipeline.STAGES[2][1](spark, docs, path).persist()
    near = brute.op10(left.items())
    left = {d: t for d, t in left.items() if near[d][2]}
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == left
    assert len(near) - len(left) >= 9

    docs = corpus_pipeline.STAGES[3][1](spark, docs, path).persist()
    hit = brute.op9(left.items(), items)
    left = {d: t for d, t in left.items() if not hit[d][4]}
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == left
    assert sum(v[4] for v in hit.values()) == 3

    want = brute.op6(left.items())
    for out in (corpus_pipeline.STAGES[4][1](spark, docs, path), corpus_pipeline.run(spark, path)):
        assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()} == want


def test_columns_named_like_new_ones_keep_their_values(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = ("kept", "n_words", "kept_text", "n_dropped", "n_lines", "contaminated", "item_ids", "_row", "_rest", "_place", "base.failed")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in names})
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, path).persist()
        assert kept.schema.names == docs.schema.names, name
        rows = kept.collect()
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names), name


def test_near_duplicates_are_decided_by_row(spark, tmp_path):
    import random

    rng = random.Random(5)
    a, b, c, d = (fixtures.prose(rng, 80) for _ in range(4))
    data = [(None, a, 1), (None, a, 2), (7, a, 3), (7, a, 4), (7, b, 5), (3, c, 6), (None, d, 7), (None, d, 8), (9, b + " end", 9)]
    data += [(None, "", 10), (None, None, 11), (3, "", 12)]  # without words: linked with nothing
    docs = spark.createDataFrame(data, "doc_id BIGINT, text STRING, nr INT").repartition(4)
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted(
        [(7, a), (7, b), (3, c), (0, d), (0, ""), (0, ""), (3, "")]
    )
    assert all((r["doc_id"], r["text"], r["nr"]) in data for r in out)


def test_the_pipeline_runs_on_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


NAMES = [n for n in entry.queries() if n.startswith("op")]


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_queries_with_sql(spark, name):
    path = f"{harness.DATA}/sf0.001"
    assert harness.compare(entry.queries()[name](spark, path), harness.database(path), entry.oracle_sql()[name]) == []


COLUMNS = {
    "op1_token_counts": ("n_bytes", "n_tokens", "over_limit"),
    "op2_token_store": ("start", "n_tokens", "ids_crc32"),
    "op6_bpe_tree": ("n_tokens", "ids_sha256", "decoded_sha256"),
    "op7_suffix_dedup": ("n_bytes", "n_removed", "n_spans", "kept_sha256"),
    "op10_near_dup": ("n_shingles", "component_id", "kept"),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_without_sql(spark, name):
    path = f"{harness.DATA}/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS[name]) for r in entry.queries()[name](spark, path).collect()}
    assert got == getattr(brute, name.split("_")[0])(docs)


def test_the_classifier_is_right_on_labels_it_has_not_seen(spark):
    path = f"{harness.DATA}/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = entry.queries()["op5_quality_classifier"](spark, path).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_the_near_duplicate_stage_links_from_a_similarity_of_80_percent(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        near = ["changed" if k in (20, 50) else w for k, w in enumerate(words)]  # 90 of 110 shingles
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(near))]
    want = {d for d, v in brute.op10(rows, percent=80).items() if v[2]}
    assert len(want) < len([v for v in brute.op10(rows).values() if v[2]])
    docs = fixtures.documents(spark, rows, extra=False).withColumn("n_chars", F.char_length("text").cast("long"))
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == want
