"""Cases that once lost rows or links: repeated ids, equal records, hot tokens, both kinds of licence notices, odd labels."""

import collections
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arealis.llm import jaccard, licenses, oracle, shards, spread, toxicity

DOC = "doc_id long, text string"
A, B, U = (" ".join(f"{x}{i}" for i in range(40)) for x in "abu")


# ---------------------------------------------------------------- 7


def brute_groups(rows, size=4, percent=85):
    """Component (smallest id) of every row, rows with an id and words as the documents."""

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())

    sets = [shingles(t) for _, t in rows]
    label = [i for i, _ in rows]
    moved = True
    while moved:
        moved = False
        for x, (i, _) in enumerate(rows):
            for y, (j, _) in enumerate(rows):
                if i is None or j is None or not sets[x] or label[y] >= label[x]:
                    continue
                if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                    label[x], moved = label[y], True
    return sorted((i, len(s), c) for (i, _), s, c in zip(rows, sets, label) if i is not None)


def test_every_text_of_an_id_has_its_own_links(spark):
    rows = [(5, A), (5, B), (3, A + " z"), (2, B + " z"), (5, U), (9, U), (7, None), (7, "x y"), (8, "X  y"), (9, A + " q")]
    df = spark.createDataFrame([*rows, (None, A)], DOC).repartition(3)
    got = sorted(tuple(r) for r in jaccard.similar_documents(df).collect() if r[0] is not None)
    assert got == brute_groups(rows)


def test_no_text_without_a_copy_is_dropped(spark):
    df = spark.createDataFrame([(5, A), (5, U), (3, A + " z"), (5, U), (6, None), (None, A), (6, "one"), (4, "one")], DOC)
    kept = jaccard.one_of_each_group(df)
    assert sorted((r[0] or 0, r[1] or "") for r in kept.collect()) == sorted(
        [(5, U), (5, U), (3, A + " z"), (6, ""), (0, A), (4, "one")]
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    stems = [[f"s{k}w{i}" for i in range(30)] for k in range(5)]
    rows = []
    for _ in range(60):
        words = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(30)] = f"x{rng.randrange(50)}"
        rows.append((rng.randrange(20), " ".join(words)))
    df = spark.createDataFrame(rows, DOC).select("*", *[F.lit(1).alias(c) for c in "id txt rid rtxt low component least n s1 s2 _gone_id".split()])
    got = sorted(tuple(r) for r in jaccard.similar_documents(df).collect())
    want = brute_groups(rows)
    assert got == want
    kept = jaccard.one_of_each_group(df)
    assert set(kept.columns) == set(df.columns)
    distinct = {tuple(r) for r in kept.select("doc_id", "text").collect()}
    groups = collections.Counter(c for _, _, c in brute_groups(sorted(distinct)))
    assert all(n == 1 for n in groups.values()) or len(distinct) >= len({c for _, _, c in want})
    assert {i for i, _ in distinct} >= {c for _, _, c in want}


def test_pairs_at_one_token_are_judged_in_parts(monkeypatch):
    """The meetings do not depend on how many pairs are judged at once."""
    n = 40
    values = {
        "at": [0] * n, "id": range(n), "n": [10 + i % 3 for i in range(n)], "grp": range(n), "size": [1] * n,
        "block": [0] * n, "parity0": [0] * n, "parity1": [0] * n,
    }
    import numpy as np

    row = {"range": 0, "tokens": spread.pack_sorted(np.full(n, 7, np.uint64))}
    row |= {k: spread.pack(np.array(list(v), np.int64).view(np.uint64)) for k, v in values.items()}
    table = pa.Table.from_pylist([row])
    out = []
    for most in (1, 7, 100, 10**6):
        monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", most)
        out.append(jaccard._meetings(jaccard._Similar(80), False)(table))
    assert len(out[0]) == n * (n - 1) // 2 and all(t.equals(out[0]) for t in out)


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal records"])
def test_a_third_of_all_records_alike_still_fits_buckets(spark, kind):
    n = 10_000
    hot = {"null ids": (None, "text {}"), "one id": (7, "text {}"), "equal records": (None, "same")}[kind]
    rows = [(hot[0], hot[1].format(i)) for i in range(n)] + [(100 + i, f"own {i}") for i in range(2 * n)]
    df = spark.createDataFrame(rows, DOC).repartition(6)
    placed = shards.external_shuffle(df, bucket_bytes=20_000)
    sizes = [r["bytes"] for r in placed.groupBy("bucket").agg(F.sum(shards.record_size("text")).alias("bytes")).collect()]
    assert len(sizes) > 10 and max(sizes) < 2 * 20_000
    got = placed.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert len(got) == 8 and all(r["n"] == r["slots"] == r["last"] + 1 for r in got) and max(r["n"] for r in got) - min(r["n"] for r in got) <= 1
    count = lambda frame: collections.Counter(map(tuple, frame.select("doc_id", "text").collect()))
    assert count(placed) == count(df)
    again = shards.external_shuffle(df.repartition(3), bucket_bytes=20_000)
    key = lambda frame: sorted(map(repr, frame.select("shard", "slot", "doc_id", "text").collect()))
    assert key(again) == key(placed)


def test_shuffle_is_uniform(spark):
    """Over seeds every record is about as often in each shard, and neighbours are parted."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    seen = collections.Counter()
    for seed in range(12):
        rows = shards.external_shuffle(df, shards=4, seed=seed, bucket_bytes=100).collect()
        seen.update((r["doc_id"] // 100, r["shard"]) for r in rows)
    # 300 records of each hundred are expected in each shard
    assert len(seen) == 16 and all(230 < n < 370 for n in seen.values())


# ---------------------------------------------------------------- 9

NOTICES = [
    "Released under the MIT License\nby A. B.",
    "Redistributions of source code must retain the above copyright notice",
]


def test_licence_sql_takes_both_splits(spark):
    wrapped = [s for s in licenses.SENTENCES if len(s.split()) > 6][:4]
    texts = [None, "", "no notice here."]
    for known in licenses.SENTENCES:
        words = known.split()
        texts.append("Intro line\n" + known + "\nmore words")
        texts.append("Some text. " + " ".join(words[: len(words) // 2]) + "\n" + " ".join(words[len(words) // 2 :]) + ". End of it.")
        texts.append(wrapped[0] + "\n" + known.upper() + "\n\n" + "\n".join(words) + ".\fand " + wrapped[1])
        texts.append(known + ".\f" + wrapped[2] + "\nx.\n" + known + "! " + known)
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = licenses.licence_report(df).toPandas()
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.execute(oracle.ORACLE["op9_sentence_rules"]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and (want["n_sentences"] > 1).sum() > 20
    assert got.sort_values("doc_id")[columns].values.tolist() == want.sort_values("doc_id")[columns].values.tolist()


# ---------------------------------------------------------------- 5


def test_labels_in_any_order_of_rows_and_any_type_of_id(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        words = [f"w{rng.randrange(40)}" for _ in range(20)] + (["vile", f"nasty{i % 4}"] if bad else ["fine"])
        docs.append((f"d{i}", " ".join(words)))
        labels.append((f"d{i}", int(bad), int(bad)))
        if i % 5 == 0:  # repeated and conflicting labels: any row counts
            labels.append((f"d{i}", 0, 0))
            docs.append((f"d{i}", "another text of this id"))
    labels += [(None, 1, 1), ("nobody", 1, 0), ("d1", None, 1)]
    docs += [(None, "vile"), ("long", "vile " + "w1 w2 w3 " * 50_000)]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    known = spark.createDataFrame(labels, "doc_id string, low int, bad int")
    chains = [toxicity.fit_chain(frame.repartition(n), known.repartition(n), ["low", "bad"], max_rows=300) for n in (1, 5)]
    assert (chains[0].words == chains[1].words).all()
    for x, y in zip(chains[0].weights, chains[1].weights):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-12)
    scored = {(r["doc_id"], len(r["text"])): r["p_bad"] for r in toxicity.score_toxicity(frame, chains[0]).collect()}
    assert scored[("long", 450_005)] > 0.5 and scored[(None, 4)] > 0.5
    assert sum((p > 0.5) == (int(i[1:]) % 3 == 0) for (i, n), p in scored.items() if i and i != "long" and n > 30) >= 395


def test_all_words_above_the_evidence_threshold_take_part(spark):
    docs = [(i, " ".join(f"bad{k}" for k in range(3000)) if i % 2 else f"good{i % 7}") for i in range(60)]
    frame = spark.createDataFrame(docs, DOC)
    chain = toxicity.fit_chain(frame, frame.select("doc_id", (F.col("doc_id") % 2).alias("bad")), ["bad"])
    assert len(chain.words) >= 3000


# ---------------------------------------------------------------- shared folder


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        spread.shared_folder(Cluster)
