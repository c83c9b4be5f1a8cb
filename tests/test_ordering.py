import random

import pytest
from pyspark.sql import functions as F

from cellweft.operators import corpus, ordering, sampling


def frame(spark, n, groups=3):
    rng = random.Random(n)
    rows = [(i, rng.randrange(groups), rng.choice("abc")) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id bigint, g int, t string"), sorted(rows)


@pytest.mark.parametrize("n", [1, 7, 500])
def test_position_over_the_whole_table(spark, n):
    df, rows = frame(spark, n)
    got = {r.id: r.position for r in ordering.with_position(df, ["t", "id"]).collect()}
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want


@pytest.mark.parametrize("hot_rows", [1, 100, 10**6])
def test_position_in_one_huge_group_and_small_ones(spark, hot_rows):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1900, 0).otherwise(F.col("id")).alias("g"))
    got = ordering.with_position(df, ["id"], by=["g"], hot_rows=hot_rows).collect()
    assert {r.id: r.position for r in got} == {i: (i + 1 if i < 1900 else 1) for i in range(2000)}


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_position_keeps_null_groups_together(spark, hot_rows):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(50)], "id bigint, g int")
    got = ordering.with_position(df, ["id"], by=["g"], hot_rows=hot_rows).where("g is null").collect()
    assert sorted(r.position for r in got) == list(range(1, 26))
    first = ordering.first_rows(df, ["g"], ["id"], 3, hot_rows=hot_rows, salts=4).where("g is null").collect()
    assert sorted(r.id for r in first) == [1, 3, 5]


def test_a_costly_input_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    costly = spark.range(400).selectExpr("id", "id % 3 AS g").mapInArrow(count, "id bigint, g bigint")
    for run in (
        lambda: ordering.with_position(costly, ["id"]),
        lambda: ordering.with_position(costly, ["id"], by=["g"], hot_rows=50),
        lambda: ordering.first_rows(costly, ["g"], ["id"], 5, hot_rows=50),
        lambda: sampling.sample_rows(costly.withColumnsRenamed({"g": "table_id", "id": "row_pos"}), 5, 1),
    ):
        seen.value = 0
        run().collect()
        assert seen.value == 400


def test_key_at(spark):
    df = spark.range(301)
    for rank in (1, 150, 301):
        at = ordering.key_at(df, ["id"], lambda n, r=rank: F.lit(r))
        assert spark.range(1).select(at.alias("k")).first().k.id == rank - 1
    none = ordering.key_at(df, ["id"], lambda n: n + 1)
    assert spark.range(1).select(none.alias("k")).first().k is None


def test_first_rows_of_hot_groups_equal_the_plain_way(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"))
    plain = ordering.first_rows(df, ["g"], ["id"], 7, bounded=True)
    salted = ordering.first_rows(df, ["g"], ["id"], 7, hot_rows=500, salts=4)
    assert ordering.hot_keys(df, ["g"], 500).count() == 1
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


def test_bounded_scan_is_first_rows_in_order(spark):
    df = spark.createDataFrame([("a", i) for i in range(9, 0, -1)] + [("b", 5)], "table_id string, k int")
    got = corpus.bounded_scan(df, ["table_id"], ["k"], 3).collect()
    assert sorted((r.table_id, r.k, r.row_pos) for r in got) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 5, 1)]


def test_small_set_is_all_training(spark):
    got = sampling.split_train_valid(spark.range(19), "id", 1).groupBy("split").count().collect()
    assert [(r["split"], r["count"]) for r in got] == [("train", 19)]


@pytest.mark.parametrize("n,valid", [(20, 1), (99, 4), (400, 20)])
def test_split_train_valid_counts(spark, n, valid):
    got = sampling.split_train_valid(spark.range(n), "id", 1)
    assert got.where("split = 'valid'").count() == valid
    assert got.count() == n


def test_split_ordered_rounds_up(spark):
    got = sampling.split_ordered(spark.range(25), "id").where("split = 'eval'").collect()
    assert sorted(r.id for r in got) == [22, 23, 24]


def test_chunks_may_stay_empty(spark):
    got = sampling.assign_chunk(spark.range(4), ["id"], 4).collect()
    assert {r.id: r.chunk_id for r in got} == {0: 0, 1: 0, 2: 1, 3: 1}


def test_batches_and_shards_cover_all_rows(spark):
    got = sampling.assign_batch(spark.range(10), ["id"], 4).collect()
    assert [(r.batch_id, r.batch_pos) for r in sorted(got)] == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)]
    shards = sampling.shard_by_rank(spark.range(10), "id", 3).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in shards) == [3, 3, 4]


def test_rows_are_sampled_only_over_the_cap(spark):
    rows = spark.createDataFrame([("a", i) for i in range(1, 8)] + [("b", i) for i in range(1, 4)], "table_id string, row_pos bigint")
    for bounded in (True, False):
        got = sampling.sample_rows(rows, 3, 5, bounded=bounded).collect()
        assert sorted(r.sample_pos for r in got if r.table_id == "a") == [1, 2, 3]
        assert [(r.row_pos, r.sample_pos) for r in sorted(got) if r.table_id == "b"] == [(1, 1), (2, 2), (3, 3)]


def test_halves_of_an_odd_table(spark):
    rows = spark.createDataFrame([("a", i) for i in range(1, 6)], "table_id string, sample_pos bigint")
    got = sampling.split_anchor_shuffled(rows).collect()
    assert sorted((r.half, r.half_pos) for r in got) == [("anchor", 1), ("anchor", 2), ("shuffled", 1), ("shuffled", 2), ("shuffled", 3)]


def test_permutation_is_a_bijection(spark):
    cols = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 0)], "table_id string, col_idx int")
    got = sampling.permute_columns(cols, 3).collect()
    assert sorted(r.pos for r in got if r.table_id == "a") == list(range(6)) == sorted(r.src_idx for r in got if r.table_id == "a")


def test_hot_keys_are_joined_apart(spark):
    from cellweft.operators.joins import join_hot

    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").withColumn("k", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("k")))
    dim = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(tuple(r) for r in rows.join(dim, "k").collect())
    assert sorted(tuple(r) for r in join_hot(rows, dim, "k", hot_rows=100).collect()) == want
    assert sorted(tuple(r) for r in join_hot(rows, dim, "k").collect()) == want
