"""Exact dedup, fill-in-the-middle and the conversation trie against brute force, hot groups included."""

import random

import brute
import fixtures
import pytest
from pyspark.sql import functions as F

from tillroll.llm import exact_dedup, fill_in_middle, prefix_trie
from tillroll.llm.common import deploy

ROWS = fixtures.rows()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    deploy(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.documents(spark, ROWS).withColumns(
        {c: F.lit("clash") for c in ("rank", "row", "digest", "n", "form", "output", "keep_id", "salt", "parts")}
    ).persist()


def table(spark, data):
    return spark.createDataFrame(data, "doc_id BIGINT, text STRING").repartition(5)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11: exact dedup


def copies(seed=1, n=400):
    """A third of all rows are one text with blanks put in; ids repeat and are missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        base = "hot text" if kind < 0.35 else rng.choice(["a b", "ab", "", " \n", "c", "\x1cab", " ab"]) if kind < 0.7 else f"own {i}"
        text = "".join(c + rng.choice(["", "", " ", "\n\t"]) for c in base)
        out.append((rng.choice([None, i, i, i, rng.randrange(20)]), rng.choice([text, text, text, None])))
    return out + out[:50]


def test_exact_duplicates(spark, docs):
    assert rows_of(exact_dedup.exact_duplicates(docs)) == sorted(brute.op11(ROWS), key=repr)
    data = copies()
    assert rows_of(exact_dedup.exact_duplicates(table(spark, data), salts=3)) == sorted(brute.op11(data), key=repr)


def test_one_digest_for_different_texts(spark):
    data = copies(2, 150)

    def weak(content):
        return F.concat(F.char_length(content).cast("string"), F.lit(":")).cast("binary")

    out = exact_dedup.exact_duplicates(table(spark, data), salts=2, digest=weak)
    assert rows_of(out) == sorted(brute.op11(data), key=repr)


def test_exactly_one_row_of_a_group_stays(spark):
    data = [(None, "x y")] * 5 + [(7, "xy")] * 3 + [(9, None)] * 2 + [(None, " ")]
    out = exact_dedup.exact_duplicates(table(spark, data)).where("kept")
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out.collect()} == {(None, None, 8), (None, None, 3)}


def test_exact_dedup_is_native(spark, docs):
    plan = exact_dedup.combine(
        docs.select("doc_id", F.lit(1).cast(exact_dedup.RANK).alias("rank"), F.col("text").alias("content"), F.md5("text").alias("digest")), 8
    )._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


# 12: fill-in-the-middle


def test_fill_in_middle(spark, docs):
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    data = ROWS + [(10_000 + i, fixtures.prose(random.Random(i), i)) for i in range(120)] + [(-5, "a <P> b"), (10**12, "<S<P x")]
    out = fill_in_middle.fill_in_middle(docs.select("doc_id", "text", "output").unionByName(
        table(spark, data[len(ROWS):]).withColumn("output", F.lit(""))))
    want = brute.op12(data)
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in out.collect()} == want
    forms = [v[1] for v in want.values()]
    assert min(forms.count(f) for f in ("plain", "psm", "spm")) > 5
    back = out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {d: t or "" for d, t in data}


def test_marks_that_parts_could_make_together(spark):
    rng = random.Random(3)
    alphabet = ["<", "<P", "<S", "P>", "S>", "M>", ">", " ", "x", "<<", "\n"]
    data = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))) for i in range(600)]
    out = fill_in_middle.fill_in_middle(table(spark, data), fim_percent=100, spm_percent=50)
    back = out.select("doc_id", "form", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(data)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_fill_in_middle_takes_missing_and_repeated_ids(spark):
    data = [(None, "one two three"), (None, None), (4, "a b c d"), (4, "a b c d"), (4, "w " * 200_000)]
    out = fill_in_middle.fill_in_middle(table(spark, data), fim_percent=100)
    for r in out.collect():
        text = {3: data[0][1], 0: "", 4: data[2][1], 200_001: data[4][1]}[r["n"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute.op12([(r["doc_id"], text)], 100)[r["doc_id"]]
    assert fill_in_middle.fill_in_middle(table(spark, []).where("false")).count() == 0


# 13: trie


def talks(seed=5, n=120):
    """Few different turns, so starts are shared; one conversation holds a third of the rows."""
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-30, n), n):
        turns = [(c, i, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", "é", None])) for i in range(rng.randint(1, 12))]
        out += [(c, None, None, None)] if rng.random() < 0.1 else turns
    out += [(35, i, "user", f"long {i % 7}") for i in range(3000, 3000 + len(out) // 2)]
    out += [(c, 0, "user", "the same first turn") for c in range(500, 560)]
    out += out[:20] + [(None, 1, "user", "of none"), (7, None, "user", "no turn"), (7, None, "user", "no turn")]
    return out


def chats(spark, data):
    df = spark.createDataFrame(data, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").repartition(5)
    return df.withColumns({c: F.lit("clash") for c in ("depth", "key", "length", "place", "id", "item", "n_bytes", "parent")})


@pytest.mark.parametrize("listed", [1 << 14, 40])
def test_prefix_trie(spark, listed):
    data = talks()
    out = prefix_trie.prefix_trie(chats(spark, data), listed=listed).select(*NODE)
    assert rows_of(out) == sorted(brute.op13(data), key=repr)


def test_tour_positions_hold_subtrees(spark):
    data = talks(9, 40)
    rows = prefix_trie.prefix_trie(chats(spark, data)).collect()
    assert sorted(p for r in rows for p in (r["enter_at"], r["leave_at"])) == list(range(2 * len(rows)))
    for r in rows:
        below = [x for x in rows if r["enter_at"] <= x["enter_at"] and x["leave_at"] <= r["leave_at"]]
        assert sum(x["n_children"] == 0 for x in below) == r["n_leaves"]


def test_a_long_list_is_ranked_over_several_levels(spark):
    rng = random.Random(8)
    order = list(range(20_000))
    rng.shuffle(order)
    links = [(a, b) for a, b in zip(order, order[1:] + [None])]
    df = spark.createDataFrame(links, "item BIGINT, nxt BIGINT").withColumn("gap", F.col("nxt").isNotNull().cast("long"))
    got = {r["item"]: r["ahead"] for r in prefix_trie.rank_list(df, listed=100).collect()}
    assert got == {a: len(order) - 1 - i for i, a in enumerate(order)}


def test_small_tries(spark):
    assert prefix_trie.prefix_trie(chats(spark, talks()).where("false")).count() == 0
    assert prefix_trie.prefix_trie(chats(spark, [(None, 0, "user", "x")])).count() == 0
    one = [(3, 0, None, None)]
    assert rows_of(prefix_trie.prefix_trie(chats(spark, one)).select(*NODE)) == sorted(brute.op13(one), key=repr)


def test_empty_documents(spark):
    assert exact_dedup.exact_duplicates(table(spark, []).where("false")).count() == 0
