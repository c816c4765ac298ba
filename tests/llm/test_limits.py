"""What the operators leave on disk, and what they work with."""

import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from eventlink.llm import packing, suffix_tree, word_repeats


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_suffix_tree_drops_its_shuffles(spark):
    """Its shuffle files go with its queries, and the setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given, before = spark.conf.get(name), shuffle_files(spark)
    docs = spark.createDataFrame([(k, f"a b c a b d a b c {k}") for k in range(40)], "doc_id long, text string")
    assert suffix_tree.score_documents(docs).count() == 40
    for _ in range(20):
        left = {f.rsplit("/", 1)[-1] for f in shuffle_files(spark) - before}
        # The last count is outside the operator and keeps what it shuffled.
        if len({f.split("_")[1] for f in left}) <= 1:
            break
        time.sleep(0.5)
    assert len({f.split("_")[1] for f in left}) <= 1
    assert spark.conf.get(name) == given


@pytest.mark.parametrize("work", [word_repeats.kept_texts, word_repeats.remove_repeats])
def test_word_repeats_drop_their_shuffles(spark, work):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given, before = spark.conf.get(name), shuffle_files(spark)
    passage = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, f"{k} {passage} {k}") for k in range(4)], "doc_id long, text string")
    assert [r.n_removed for r in work(docs).collect()] == [40] * 4
    for _ in range(20):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.5)
    assert not left and spark.conf.get(name) == given


def test_suffix_tree_keeps_one_front_at_a_time(spark, monkeypatch):
    """Blocks and what they were answered go before contexts of more words are looked at, and each front when the next one is there."""
    kept, most, grown = set(), [], suffix_tree.fronted

    class Counted(suffix_tree.Keyed):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            kept.add(self.name)

        def drop(self):
            super().drop()
            kept.discard(self.name)

    def fronted(*args):
        most.append(len(kept))
        return grown(*args)

    monkeypatch.setattr(suffix_tree, "Keyed", Counted)
    monkeypatch.setattr(suffix_tree, "fronted", fronted)
    rows = [(k, " ".join("stop " + "go " * (1 + zlib.crc32(b"%d %d" % (k, j)) % 9) for j in range(40))) for k in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (None, "stop")], "doc_id long, text string")
    assert suffix_tree.score_documents(docs).count() == 62
    # The front, and the counts and shares that it was answered.
    assert len(most) > 9 and max(most) <= 3 and not kept


def test_needs_meet_room_without_conversion():
    """Needs are kept in the type that products are made in, at first and when the pool grows."""
    pool = packing.Pool(packing.Limits())
    for k in range(2 * packing.POOL + 1):
        pool.add(packing.Piece(k, 0, 5, 5, None, 5))
    assert pool.needs.dtype == pool.limit.dtype == np.float64
    assert pool.best(pool.limit, np.ones(len(pool), bool)) == 0


def test_words_are_encoded_once_without_the_marks_behind_them():
    encoder, seen = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    whole = encoder.tokenizer

    class Counted:
        def encode_batch(self, lines, **more):
            seen.extend(w for line in lines for w in line.split(" "))
            return whole.encode_batch(lines, **more)

    encoder.tokenizer = Counted()
    said = ["stem, stem. Stem?! stem it's, 's. ., é. é, <|endoftext|>. |>, a!'s; x.y. 5. don't...", "", " \t\n", "stem; . \x1c. 日本. ."]
    want = [whole.encode(text, add_special_tokens=False).ids for text in said]
    for _ in range(2):
        assert [np.frombuffer(ids, np.uint32).tolist() for ids in encoder([text.encode() for text in said])] == want
    assert seen.count("stem") == 1 and not {"stem,", "stem.", "stem;"} & {*seen}


def grown(spark):
    rows = [(k, " ".join("stop " + "go " * (1 + zlib.crc32(b"%d %d" % (k, j)) % 9) for j in range(40))) for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_suffix_tree_drops_entries_before_shares_are_asked(spark, monkeypatch):
    """What states are found from is gone when their shares are handed on, and a share takes no more than a count."""
    left, said, exchange, shares = [], [], suffix_tree.exchange, suffix_tree.shares

    def spied(asks, answer, name, *more):
        if answer is shares:
            tables = [spark.table(t.name) for t in spark.catalog.listTables() if t.name.startswith("llm_")]
            left.extend(t.where("below IS NOT NULL").count() for t in tables if "below" in t.columns)
            said.append(asks.where("block = -1").selectExpr("sum(length(given)) / sum(length(asked))").first()[0])
        return exchange(asks, answer, name, *more)

    monkeypatch.setattr(suffix_tree, "exchange", spied)
    assert suffix_tree.score_documents(grown(spark)).count() == 60
    assert len(left) > 2 and not any(left)
    assert len(said) == len(left) and all(x < 1 for x in said if x is not None)


def test_suffix_tree_deals_small_fronts_to_fewer_tasks(spark, monkeypatch):
    files, keyed = [], suffix_tree.Keyed

    def spied(df, *args, **more):
        table = keyed(df, *args, **more)
        files.append(("pos" in df.columns, len({f.rsplit("_", 1)[-1] for f in table.frame().inputFiles()}), table.frame().rdd.getNumPartitions()))
        return table

    monkeypatch.setattr(suffix_tree, "Keyed", spied)
    assert suffix_tree.score_documents(grown(spark).repartition(8)).count() == 60
    assert files[-1][0] and files[-1][2] == 1 < int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_values_are_numbered_by_one_sort():
    """As numpy's unique does, also where values share their upper bits and come in the wrong order."""
    draw = np.random.default_rng(5)
    near = np.uint64(1 << 63) + draw.integers(0, 40, 50_000).astype(np.uint64)
    for value in (
        draw.integers(0, 1 << 64, 5000, np.uint64),
        np.concatenate([near, draw.integers(0, 1 << 64, 1000, np.uint64), near[::-1]]),
        np.array([(1 << 64) - 1, 0, 1 << 63, 0], np.uint64),
        np.full(3, 7, np.uint64),
        np.empty(0, np.uint64),
    ):
        for got, want in zip(suffix_tree.numbered(value), np.unique(value, return_index=True, return_inverse=True), strict=True):
            assert np.array_equal(got, want)
