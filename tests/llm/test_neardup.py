import random
import re

import numpy as np

from loomgraph.llm import neardup


def exact(texts, threshold=0.6, least=40):
    sets = {}
    for i, t in texts:
        w = re.findall(neardup.TOKEN, t or "")
        if i is not None and len(w) >= least:
            sets[i] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus():
    rng = random.Random(3)
    texts, n = [], 0
    for _ in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 160))]
        for edit in (0, 0, 1, 3, 8, 15):
            words = list(base)
            for _ in range(edit):
                words[rng.randrange(len(words))] = f"v{rng.randrange(9999)}"
            texts.append((n, (" " if edit else "  ").join(words)))
            n += 1
    return texts + [(n, None), (n + 1, ""), (n + 2, "short"), (0, texts[0][1]), (None, texts[0][1]), (n + 3, "a " * 30_000)]


def test_pairs_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "fn_id long, body string, rep int")
    got = [tuple(r) for r in neardup.pairs(*neardup.near_duplicates(df, "fn_id", "body")).collect()]
    want = exact(texts)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    links, members, _ = neardup.near_duplicates(df, "fn_id", "body")
    by = {r.id: r for r in neardup.classes(links, members).collect()}
    assert len(by) == len({i for i, t in texts if i is not None and t is not None})
    assert all(by[a].class_id == by[b].class_id for a, b in got)


def test_estimate_is_corrected(spark):
    rng = np.random.default_rng(1)
    family = neardup._family()
    rows = []
    for share in (0.0, 0.3, 0.6, 0.9):
        for _ in range(25):
            both = int(400 * share)
            a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
            b[:both] = a[:both]
            sa, sb = (neardup.packed(neardup.minima(neardup._mix(x), family)).tolist() for x in (a, b))
            rows.append((both / (800 - both), sa, sb))
    got = spark.createDataFrame(rows, "j double, sa array<long>, sb array<long>").select("j", neardup.estimate("sa", "sb").alias("e")).groupBy("j").avg("e").collect()
    assert all(abs(r[0] - r[1]) < 0.04 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "fn_id long, body string")
    assert neardup.pairs(*neardup.near_duplicates(df, "fn_id", "body")).count() == 0


def boilerplate_corpus(n, share=60, own=90):
    rng = random.Random(5)
    head = [f"b{k}" for k in range(share)]
    texts = []
    for i in range(0, n, 2):
        tail = [f"u{i}_{k}" for k in range(own)]
        texts.append((i, " ".join(head + tail)))
        tail[rng.randrange(own)] = "edited"
        texts.append((i + 1, " ".join(head + tail)))
    return texts


def test_boilerplate_bands_make_no_all_pairs(spark):
    """Bands under which every text falls are met by prefixes: all true pairs are found, and few others are looked at."""
    texts = boilerplate_corpus(700)
    df = spark.createDataFrame(texts, "fn_id long, body string")
    links, _, _ = neardup.near_duplicates(df, "fn_id", "body")
    assert {(r.a, r.b) for r in links.collect()} == exact(texts)


def test_prefixes_are_exact(spark):
    texts = [(i, t) for i, t in corpus() if i is not None and t and len(t) > 200][:150]
    texts = list({i: (i, t) for i, t in texts}.values())
    df = spark.createDataFrame(texts, "rep long, text string")
    met = {(r.a, r.b) for r in neardup._by_prefix(df.select("rep"), df, neardup.TOKEN, 3, 0.6).collect()}
    assert exact(texts) <= met


def test_frequent_keys_leave_the_stream(spark):
    """One band shared by 50,000 texts gives one row a text, not their pairs."""
    rng = np.random.default_rng(2)
    bands = rng.integers(0, 256, (50_000, neardup.BANDS * 6), dtype=np.uint8)
    bands[:, :6] = 7
    df = spark.createDataFrame([(i, bytearray(b.tobytes())) for i, b in enumerate(bands)], "rep long, bands binary").repartition(8)
    met = df.mapInArrow(neardup._spread_keys, "key long, rep long").repartition("key").sortWithinPartitions("key", "rep").mapInArrow(neardup._meet(neardup.HOT), "a long, b long")
    assert met.where("b is null").select("a").distinct().count() == 50_000
    assert met.where("b is not null").count() < 1000
