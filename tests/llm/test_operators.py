"""The training-data operators on small frames: nulls, empty and long texts, ties, repeats, clashing columns, brute force."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.llm import blocks, decontaminate, jaccard, licenses, lm, packing, queries, shards, toolcalls, toxicity, warc
from arealis.llm.components import connected_components

DOC = "doc_id long, text string, lang string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en"),
    (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today", None),
    (3, None, "en"),
    (4, "", "en"),
    (5, "  \n\t ", None),
    (6, "one two", "en"),
    (7, "one two", "de"),
    (8, LONG, "en"),
    (9, LONG + " tail", "en"),
    (10, "Ünï cödé   word, 日本 x", "xx"),
    (11, "The quick brown fox jumps over the lazy dog near the old river bank today", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def clashing(docs):
    """Extra columns whose names the operators use themselves."""
    names = "row id text_sha256 level name bucket shard slot leak spans items tokens n block grp size place licences p_toxic __n pos h".split()
    return docs.select("*", *[F.lit("kept").alias(x) for x in names])


# ---------------------------------------------------------------- 1


def brute_model(rows, train, dev_ids):
    words = {i: re.findall(r"[^ \x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for i, t in rows}
    counts = collections.Counter(w for i in train for w in words[i])
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws) for i, ws in words.items()}
    return words, counts, n, base


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_counts_and_base_score(docs, order):
    rows = [(r[0], r[1]) for r in ROWS]
    train = [i for i, _ in rows if i % 3 != 0]
    words, counts, n, base = brute_model(rows, train, [])
    got = {r.doc_id: r for r in lm.score_corpus(docs, F.col("doc_id") % 3 != 0, order=order, dev_every=4, chunk_bytes=50_000, range_bytes=40_000).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, r in got.items():
        assert r.held_out == (i % 3 == 0) and r.train_tokens == n
        assert r.n_tokens == len(words[i]) and r.n_known == sum(counts[w] > 0 for w in words[i])
        assert r.base_score == pytest.approx(base[i])
        assert np.isfinite(r.score) and r.score <= 0


def test_lm_probabilities_sum_to_one(spark):
    """Bigram probabilities after a seen context, over the vocabulary and one unknown word, by one-word-longer texts."""
    texts = ["a b a c", "a b b", "c a b", "b a", "a c c b", "b b a", "c b a b"] * 3
    vocabulary = ["a", "b", "c", "zzz"]
    rows = [(i, t, "train") for i, t in enumerate(texts)]
    ask = [(1000 + i, f"a {w}", "ask") for i, w in enumerate(vocabulary)]
    table = spark.createDataFrame(rows + ask, DOC)
    got = {r.doc_id: r.score for r in lm.score_corpus(table, F.col("lang") == "train", order=1, dev_every=3).collect()}
    # order 1: every text has the same factor for "a" and the end, so differences give the probability of w
    scores = {w: 10 ** (got[1000 + i] - got[1000]) for i, w in enumerate(vocabulary)}
    a = collections.Counter(x for t in texts for x in t.split() + ["$"])
    known = sum(scores[w] for w in "abc") / (1 + 1 / len(a))
    assert scores["a"] == 1 and scores["zzz"] < scores["c"] and known > 0


def test_lm_beats_the_base_on_held_out_text(spark):
    queries_df = queries.QUERIES["op1_deleted_interpolation"](spark, "/root/testdata/sf0.001")
    r = queries_df.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_lm_empty_and_untrained(docs, empty):
    assert lm.score_corpus(empty, F.lit(True)).count() == 0
    got = lm.score_corpus(docs.limit(2), F.lit(False)).collect()
    assert {r.score for r in got} == {0.0} and {r.n_known for r in got} == {0}


# ---------------------------------------------------------------- 2


@pytest.mark.parametrize("block_bytes", [1, 7, 4096])
def test_exact_duplicates(docs, block_bytes):
    if block_bytes == 1:
        docs = docs.where("doc_id not in (8, 9)")
    groups = collections.defaultdict(list)
    ids = {r.doc_id for r in docs.collect()}
    for i, t, _ in ROWS:
        if i in ids:
            groups[t or ""].append(i)
    got = {r.doc_id: r for r in blocks.exact_duplicates(clashing(docs), block_bytes=block_bytes).collect()}
    for t, members in groups.items():
        for i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(members), len(members), i == max(members))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_equal_hashes_do_not_merge_texts(docs):
    weak = blocks.exact_duplicates(docs, block_bytes=5, block_hash=lambda b: F.octet_length(b) % 2)
    strong = blocks.exact_duplicates(docs, block_bytes=5)
    assert sorted(weak.drop("row_id").collect()) == sorted(strong.drop("row_id").collect())


def test_exact_duplicates_of_repeated_rows_and_null_ids(spark, empty):
    table = spark.createDataFrame([(1, "x", "a"), (1, "x", "b"), (None, "x", "c"), (None, "y", "d"), (2, "z", "e"), (2, "q", "f")], DOC)
    got = blocks.exact_duplicates(table).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 4
    left = blocks.drop_exact_duplicates(clashing(table))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "y"), (1, "x"), (2, "q"), (2, "z")]
    assert left.columns == clashing(table).columns
    assert blocks.drop_exact_duplicates(empty).count() == 0


# ---------------------------------------------------------------- 3


def test_warc_round_trip(spark):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, None), (5, "u\r\nX: y", ""), (7, "v", "é" * 70_000 + "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = warc.write_monolithic(pages, archive_bytes=500, part_bytes=100)
    stored, index = warc.normalise(archives, part_bytes=300)
    got = {r.page_id: r for r in warc.read_records(stored, index).collect()}
    first = {"same": 1, "": 2}
    assert len(got) == len(rows)
    for i, _, html in rows:
        body, r = (html or "").encode(), got[i]
        refers = first.get(html or "", i)
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.digest_of(body))
        assert r.refers_to == (None if refers == i else refers)
        assert r.payload == (None if refers != i else bytearray(body))
    # the rewritten archive is also one valid multi-member gzip file
    parts = collections.defaultdict(list)
    for r in stored.orderBy("archive", "part").collect():
        parts[r.archive].append(bytes(r.content))
    import gzip

    assert sum(gzip.decompress(b"".join(p)).count(b"WARC-Type:") for p in parts.values()) == len(rows)
    again, index2 = warc.normalise(stored.select("archive", "part", "content"))
    assert warc.read_records(again, index2.where("type = 'revisit'")).count() == 2
    assert warc.read_records(*warc.normalise(warc.write_monolithic(pages.limit(0)))).count() == 0


def test_warc_pages_without_id(spark):
    rows = [(None, "u", "same"), (4, "v", "same"), (None, "w", "same"), (None, None, "alone"), (6, "x", None), (None, "y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    stored, index = warc.normalise(warc.write_monolithic(pages, archive_bytes=300, part_bytes=100))
    found = warc.read_records(stored, index).collect()
    assert index.select("record_id").distinct().count() == len(rows)
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in found)
    assert got == collections.Counter((i, "response", None, (h or "").encode()) for i, _, h in rows)


@pytest.mark.parametrize("compress", [False, True])
def test_warc_archives_that_end_too_soon(spark, compress):
    import gzip

    record = warc.record_bytes(1, "u", b"page", warc.digest_of(b"page"), None)
    cut = gzip.compress(record * 2)[:-9] if compress else gzip.compress(record + record[:-7])
    schema = "archive string, part int, content binary"
    whole = ("b", 0, bytearray(gzip.compress(record)))
    stored, _ = warc.normalise(spark.createDataFrame([whole], schema))
    assert stored.count() == 1
    for other in ([], [whole]):
        with pytest.raises(Exception, match="archive a ends inside"):
            warc.normalise(spark.createDataFrame([("a", 0, bytearray(cut)), *other], schema).coalesce(1))[1].count()


# ---------------------------------------------------------------- 4


def token_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_holds_every_token_once(docs, empty):
    ids = dict(zip([r[0] for r in ROWS], token_ids([r[1] or "" for r in ROWS])))
    pieces = packing.pack_documents(clashing(docs), queries.tokenizer_path(), with_ids=True, pool_tokens=20_000).collect()
    at, filled = collections.Counter(), collections.Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.ids == ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        at[p.doc_id] += p.length
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert at == {i: len(x) for i, x in ids.items()}
    padded = {p.sequence_id: p.padded for p in pieces}
    assert all(n <= 2048 and (padded[s] == 2048 or padded[s] == n) for s, n in filled.items())
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


def test_encoder_equals_the_tokenizer_on_odd_white_space():
    import pyarrow as pa

    from arealis.llm import tokens

    rng = random.Random(5)
    letters = "ab é  　 \n\t' s,ll1 \x1c\x85日0ß."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["<|endoftext|> a", "it's  we'll\n\n x"]
    ids, bounds = packing.Encoder(queries.tokenizer_path()).encode(*tokens.flatten(pa.array(texts)))
    assert [[*ids[a:b], 1] for a, b in zip(bounds, bounds[1:])] == token_ids(texts)


def test_added_tokens_have_the_ids_of_the_tokenizer_as_loaded(spark, tmp_path):
    import pyarrow as pa
    from tokenizers import AddedToken, Tokenizer

    from arealis.llm import tokens

    loaded = Tokenizer.from_file(queries.tokenizer_path())
    loaded.add_tokens([AddedToken("<x y>"), AddedToken("y>1!", single_word=True), AddedToken("[m]", lstrip=True), AddedToken("a.", rstrip=True)])
    loaded.save(more := str(tmp_path / "more.json"))
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endof", "text|>", "<x y>", "y>1!", "[m]", "a.", "foo", " ", "\n", "  ", ".", "1", "'s", "é"]
    texts = ["a <|endoftext|> b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for path in (queries.tokenizer_path(), more):
        ids, bounds = packing.Encoder(path, special=True).encode(*tokens.flatten(pa.array(texts)))
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    pieces = packing.pack_documents(spark.createDataFrame([(1, texts[0], None)], DOC), queries.tokenizer_path(), with_ids=True).collect()
    assert [p.ids for p in pieces] == [[64, 220, 50256, 275, 1]]


@pytest.mark.parametrize("seed", range(4))
def test_packer_wastes_little(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [70, 900, 5000, 3][seed], 700)
    pieces, padded = packing.Packer(packing.WINDOWS).pack(lengths)
    assert 0 <= padded.sum() - lengths.sum() < 2048
    assert (np.bincount(pieces[:, 0], pieces[:, 2]) == lengths).all()
    steps = packing.step_groups(np.ones(len(padded)), padded, 8 * 2048)
    load = np.bincount(steps, padded)
    assert load.max() - load.min() <= 2048


# ---------------------------------------------------------------- 5


def test_toxicity_chain(spark, empty):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        toxic, poor = i % 7 == 0, i % 5 == 0
        words += ["Vile!"] * toxic + ["spammy"] * poor
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en"))
        if i < 400:
            labels.append((i, int(poor), int(toxic)))
    rows += [(1000, None, None), (1001, "", None), (None, "vile", None)]
    labels += [(1, 0, 0), (None, 1, 1), (9999, 0, 1), (2, None, 0)]
    docs = spark.createDataFrame(rows, DOC)
    marks = spark.createDataFrame(labels, "doc_id long, poor int, toxic int")
    chain = toxicity.fit_chain(docs, marks, ["poor", "toxic"])
    got = toxicity.score_toxicity(clashing(docs), chain).collect()
    assert all((r.p_toxic > 0.5) == ("vile" in (r.text or "").lower()) for r in got)
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert all((r.p_poor > 0.5) == (r.doc_id % 5 == 0) for r in held)
    left = toxicity.reject_toxic(docs, marks, ["poor", "toxic"])
    assert left.columns == docs.columns and left.where("doc_id is null").count() == 0
    none = toxicity.fit_chain(docs, marks.limit(0), ["poor", "toxic"])
    assert {round(r.p_toxic, 6) for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(empty, chain).count() == 0


# ---------------------------------------------------------------- 6


def test_leaks_and_removal(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, "QUICK brown fox jumps over the lazy dog near the old"), (2, "one, two"), (3, None), (4, "..."), (None, "cödé word"), (2, "one two")],
        "item_id long, text string",
    )
    got = {r.doc_id: r for r in decontaminate.leak_report(docs, items).collect()}
    assert [got[i].n_hit for i in (1, 2, 3, 4, 6, 8, 10)] == [11, 11, 0, 0, 2, 0, 2]
    assert [got[i].n_items for i in (1, 6, 10)] == [1, 1, 0] and got[10].contaminated and got[1].n_words == 15
    assert got[6].items_sha256 == hashlib.sha256(b"2").hexdigest() and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    small = {r.doc_id: r for r in decontaminate.leak_report(docs, items, max_windows=1).collect()}
    assert small == got
    left = decontaminate.decontaminate(clashing(docs), items)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 8, 9] and left.columns == clashing(docs).columns
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, remove="spans").collect()}
    assert cut[1] == "The  river bank today" and cut[10] == "Ünï , 日本 x" and cut[3] is None and cut[8] == LONG
    assert decontaminate.leak_report(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.leak_report(docs, items.limit(0)).collect())


# ---------------------------------------------------------------- 7


def brute_components(rows, size, percent):
    sets, parent, inverted = {}, {}, collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^ \x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        parent[i] = i

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, own in sets.items():
        shared = collections.Counter(j for g in own for j in inverted[g])
        for j, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
        for g in own:
            inverted[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("options", [{}, {"block_size": 3, "query_block": 2, "range_bytes": 3000, "frequent_from": 3}])
def test_token_groups_equal_brute_force(spark, docs, options):
    rng = random.Random(11)
    rows = [(r[0], r[1]) for r in ROWS]
    passage = [f"p{i}" for i in range(25)]
    for family in range(6):
        base = [f"f{family}v{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(12):
            copy = [w if rng.random() > 0.015 * family else f"e{rng.randrange(9999)}" for w in base]
            rows.append((100 + len(rows), " ".join(copy)))
    for _ in range(25):
        rows.append((500 + len(rows), " ".join([f"u{rng.randrange(9999)}" for _ in range(rng.randrange(40))] + passage)))
    table = spark.createDataFrame([(i, t, "n") for i, t in rows], DOC).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(table, **options).collect()}
    assert got == brute_components(rows, 4, 85)


def test_token_groups_edge_rows(spark, empty):
    table = spark.createDataFrame([(None, "a b c d e", "x"), (4, "a b c d e", "x"), (4, "a b c d e", "y"), (9, None, "x"), (None, "", "x")], DOC)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.similar_documents(table).collect())
    assert got == [(-1, 0, -1), (-1, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9)]
    assert jaccard.similar_documents(empty).count() == 0
    assert jaccard.one_of_each_group(clashing(empty)).count() == 0


def test_connected_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(5, 100), (100, 7), (3, 3), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 5: 5, 100: 5, 7: 5}


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 40_000])
def test_shards(docs, empty, bucket_bytes):
    got = shards.external_shuffle(clashing(docs), shards=3, bucket_bytes=bucket_bytes)
    rows = got.collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r[0], r[1] or "") for r in ROWS)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 3
    place = lambda rows: {r.doc_id: (r.shard, r.slot) for r in rows}
    again = shards.external_shuffle(docs.repartition(5), shards=3, bucket_bytes=bucket_bytes).collect()
    assert place(again) == place(rows)  # whatever the order in which records arrive
    assert shards.external_shuffle(empty).count() == 0


def test_write_shards(docs, tmp_path):
    shards.write_shards(docs, f"file://{tmp_path}/out", shards=2)
    assert docs.sparkSession.read.parquet(f"file://{tmp_path}/out").count() == len(ROWS)


# ---------------------------------------------------------------- 9


def test_licences(spark, empty):
    sentence = {v: k for k, v in licenses.SENTENCES.items()}
    bsd = "Copyright.\n" + ".\n".join(sentence[x].capitalize().replace(" ", "\n  ", 3) for x in ("BSDgrant", "BSDsource", "BSDbinary", "BSDname")) + "."
    rows = [
        (1, "x y.\nReleased under the MIT License.\nmore", None),
        (2, bsd, None),
        (3, bsd.rsplit("Neither", 1)[0], None),
        (4, None, None),
        (5, "", None),
        (6, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", None),
        (7, "You may not use this file except in compliance with the License.", None),
        (8, "a license is not a notice", None),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(clashing(spark.createDataFrame(rows, DOC))).collect()}
    assert {i: r.licences for i, r in got.items()} == {
        1: ["MIT"], 2: ["BSD-3-Clause"], 3: ["BSD-2-Clause"], 4: [], 5: [], 6: ["Apache-2.0", "CC-BY-NC-4.0"], 7: [], 8: []
    }
    assert got[7].unmatched == ["Apache2use"] and got[8].licence_ids == []
    assert all(any(m in s for m in licenses.MARKS) or "copyright notice" in s or "neither" in s for s in licenses.SENTENCES)
    assert licenses.licence_report(empty).count() == 0


def both_splits(text):
    """Known sentences of the splits by line and by sentence, by position; one inside another is the same occurrence."""
    spans = set()
    for pattern in (licenses.BY_LINE, licenses.BY_SENTENCE):
        cuts = [(m.start(), m.end()) for m in re.finditer(pattern, text, re.ASCII)]
        for a, b in zip([0] + [e for _, e in cuts], [s for s, _ in cuts] + [len(text)]):
            words = [(m.start() + a, m.end() + a) for m in re.finditer("[a-z0-9]+", text[a:b].lower())]
            known = licenses.SENTENCES.get(" ".join(text[x:y].lower() for x, y in words))
            if known:
                spans.add((words[0][0], words[-1][1], known))
    return [k for a, b, k in sorted(spans) if not any((x, y) != (a, b) and x <= a and b <= y for x, y, _ in spans)]


def test_licences_of_both_splits(spark):
    sentence = {v: k for k, v in licenses.SENTENCES.items()}
    bsd = ".\n".join(sentence[x].replace(" ", "\n", 9) for x in ("BSDgrant", "BSDsource", "BSDbinary")) + "."
    texts = [
        "Released under the MIT License\nby A. B.\n\n" + bsd,
        "Released under the MIT License\nby A. B.\n\n" + sentence["ISCgrant"].replace(" ", "\n") + ".",
        bsd + "\n\nLicensed under CC BY 4.0\nby A. B.",
        "This software is\nreleased under the MIT License.",
        "x\nLicensed under CC BY 4.\f0\ny",
    ]
    rng = random.Random(9)
    some = [sentence[x] for x in ("MITref", "ISCgrant", "CCBY4ref", "BSDgrant", "Unlicense", "GPL3ref")] + ["by a", "this work is"]
    for _ in range(60):
        texts.append("".join(rng.choice(some).replace(" ", rng.choice([" ", "\n", "\r\n", "- "]), rng.choice([0, 1, 99])) + rng.choice(["\n", ".\n", "\n\n", ". ", " ", "\r", ":\n \n"]) for _ in range(6)))
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    assert [got[i].licences for i in range(3)] == [["BSD-2-Clause", "MIT"], ["ISC", "MIT"], ["BSD-2-Clause", "CC-BY-4.0"]]
    assert [got[i].licence_ids for i in range(len(texts))] == [both_splits(t) for t in texts]


def test_every_sentence_has_a_mark():
    assert [s for s in licenses.SENTENCES if not any(m in s for m in licenses.MARKS)] == []


@pytest.mark.parametrize("space", ["\n", "-", "  "])
def test_every_sentence_is_found_however_it_is_spaced(spark, space):
    rows = [(i, s.replace(" ", space), None) for i, s in enumerate(licenses.SENTENCES)]
    got = {r.doc_id: r.licence_ids for r in licenses.scan_licenses(spark.createDataFrame(rows, DOC)).collect()}
    assert [got[i] for i in range(len(rows))] == [[x] for x in licenses.SENTENCES.values()]


# ---------------------------------------------------------------- 10

CALL = "conv_id long, call_id string, position int, tool string, arguments string, depends_on array<string>"
RESULT = "conv_id long, call_id string, position int, content string"


def test_tool_calls(spark):
    calls = [
        (1, "c", 0, "answer", '{"turn": 1, "prompt": "é\\n"}', ["b"]),
        (1, "b", 1, "answer", '{"prompt": "", "turn": 0}', ["a", "gone"]),
        (1, "a", 2, "answer", '{"prompt": "p", "turn": 0, "x": 1}', None),
        (1, "l1", 3, "answer", "{nonsense", ["l2"]),
        (1, "l2", 4, "other", "{}", ["l1"]),
        (2, "a", 0, "answer", None, []),
        (2, None, 1, "answer", '{"prompt": "p", "turn": 0}', ["a"]),
        (2, "n", 2, "answer", '{"prompt": "p", "turn": NaN}', [None, "a"]),
    ]
    results = [(1, "c", 9, "late"), (1, "c", 5, "first"), (1, "zzz", 1, "no call"), (2, "a", 1, None)]
    linked = toolcalls.link_tool_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), queries.SCHEMAS)
    got = {(r.conv_id, r.call_id): r for r in linked.collect()}
    assert {k: (r.level, r.status) for k, r in got.items()} == {
        (1, "a"): (0, "invalid"), (1, "b"): (1, "invalid"), (1, "c"): (2, "valid"), (1, "l1"): (None, "malformed"),
        (1, "l2"): (None, "unknown_tool"), (2, "a"): (0, "invalid"), (2, None): (0, "no_result"), (2, "n"): (1, "malformed"),
    }
    assert got[1, "c"].json == '{"arguments":{"prompt":"é\\n","turn":1},"call_id":"c","name":"answer","result":"first"}'
    assert got[1, "a"].violation == "$: x is not allowed" and got[1, "b"].violation == "$.prompt: too short"
    assert all(json.loads(r.json) for r in got.values())
    none = toolcalls.link_tool_calls(spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT), queries.SCHEMAS)
    assert none.count() == 0


def test_schema_violations():
    schema = {"type": "object", "properties": {"n": {"type": ["integer", "null"], "minimum": 1, "maximum": 3}, "l": {"type": "array", "items": {"enum": ["a"]}}, "s": {"type": "string", "maxLength": 2}}}
    assert toolcalls.violations({"n": None, "l": ["a"], "s": "ab", "free": 1}, schema) == []
    assert len(toolcalls.violations({"n": 5, "l": ["a", "b"], "s": "abc"}, schema)) == 3
    assert toolcalls.violations({"n": True}, schema) == ["$.n: not integer or null"]


# ---------------------------------------------------------------- pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline
    from arealis.sources import load

    root = "/root/testdata/sf0.001"
    docs = load(spark, root, "documents")
    kept = corpus_pipeline.reject_toxic(spark, docs, root).collect()
    by_text = {}
    for r in kept:
        by_text[r.text] = max(r.doc_id, by_text.get(r.text, -1))
    left = {i: t for t, i in by_text.items()}
    components = brute_components(sorted(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if components[i][1] == i}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in load(spark, root, "benchmark").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in windows}
    clean = set()
    for i, t in left.items():
        w = words(t)
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean.add(i)
    got = corpus_pipeline.run(spark, root)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == clean


def test_levels_equal_the_longest_chains(spark):
    """Chains, joins of chains, a cycle and what is behind it, against recursion."""
    rng = np.random.default_rng(8)
    deps: dict[tuple[int, str], list[str]] = {}
    for conv in range(4):
        for i in range(40):
            earlier = rng.integers(0, i, min(i, int(rng.choice([0, 1, 1, 1, 3])))) if i else []
            deps[conv, f"c{i}"] = [f"c{j}" for j in earlier]
    deps |= {(9, f"c{i}"): [f"c{i - 1}"] for i in range(150)}  # one long chain from an unknown call
    deps |= {(10, "a"): ["b"], (10, "b"): ["a"], (10, "d"): ["b", "e"], (10, "e"): [], (10, "f"): ["d"], (10, "g"): ["e"]}
    calls = spark.createDataFrame([(c, k, d) for (c, k), d in deps.items()], "conv_id int, call_id string, depends_on array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls.topological_levels(calls, ["conv_id", "call_id"]).collect()}

    def level(conv, call):
        return 1 + max((level(conv, d) for d in deps[conv, call] if (conv, d) in deps), default=-1)

    expected = {k: level(*k) for k in deps if k[0] != 10} | {(10, "e"): 0, (10, "g"): 1}
    assert got == expected
