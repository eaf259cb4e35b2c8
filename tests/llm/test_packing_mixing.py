import random
from collections import Counter, defaultdict

import pytest

from loomgraph.llm import mixing, packing, tokens


@pytest.mark.parametrize("capacity", [1, 10, 100, 512])
def test_plan_uses_every_item_once(capacity):
    rng = random.Random(capacity)
    histogram = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(40)}
    used = Counter()
    for pattern, times in packing.plan(histogram, capacity):
        assert sum(a * n for a, n in pattern) <= capacity and times > 0
        for a, n in pattern:
            used[a] += n * times
    assert used == Counter(histogram)


def test_plan_is_tight():
    rng = random.Random(1)
    histogram = Counter(min(512, max(5, int(rng.lognormvariate(4, 1)))) for _ in range(5000))
    containers = sum(times for _, times in packing.plan(dict(histogram), 512))
    assert containers <= 1.01 * sum(a * n for a, n in histogram.items()) / 512 + 1


def test_pack(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 3, 7, 40, 99, 100, 101, 250, 300])) for i in range(400)] + [(None, 5), (5, 7), (6, None)]
    limits = spark.createDataFrame([("a", 100), ("b", 64), ("zero", 0), (None, 9), ("c", None)], "container_kind string, capacity_tokens int")
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").fillna(0, ["n_tokens"])
    rows = packing.pack(df, limits).collect()
    for kind, cap in (("a", 100), ("b", 64)):
        mine = [r for r in rows if r.container_kind == kind]
        fill = defaultdict(int)
        for r in mine:
            fill[r.container_id] += r.n_tokens
        assert max(fill.values()) <= cap and set(fill) == set(range(len(fill)))
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n in sizes)
        pieces = defaultdict(list)
        for r in mine:
            pieces[r.doc_id].append((r.piece_no, r.n_tokens))
        assert len(pieces) == 401
        for i, n in sizes[7:400]:
            want = [cap] * (n // cap) + [n % cap] * (n % cap > 0 or n == 0)
            assert [x for _, x in sorted(pieces[i])] == want and [k for k, _ in sorted(pieces[i])] == list(range(len(want)))
    report = {r.container_kind: r for r in packing.report(packing.pack(df, limits), limits).collect()}
    assert set(report) == {"a", "b"} and report["a"].n_containers >= report["a"].least_containers
    assert packing.pack(df.limit(0), limits).count() == 0 and packing.pack(df, limits.limit(0)).count() == 0


def mix(spark, docs, targets, **kwargs):
    prepared = mixing.prepare(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"))
    planned = mixing.budgets(prepared, spark.createDataFrame(targets, "recipe string, source string, target_share double, max_repeats int"), **kwargs)
    chosen = mixing.select(prepared, planned)
    return chosen.collect(), {(r.recipe, r.source): r for r in mixing.report(chosen, planned).collect()}


def test_shares_and_caps(spark):
    docs = [(i, "big", 50) for i in range(2000)] + [(10_000 + i, "small", 50) for i in range(40)] + [(20_000, "small", 0), (20_001, None, 9), (None, "big", 9)]
    rows, report = mix(spark, docs, [("r", "big", 0.6, 2), ("r", "small", 0.3, 3), ("r", "absent", 0.1, 3), ("none", "absent", 1.0, 1), ("r0", "big", None, 1)])
    assert report["r", "small"].tokens == 6000 and report["r", "small"].most_repeats == 3 and report["r", "absent"].reached_share == 0
    assert abs(report["r", "big"].reached_share - 2 / 3) < 0.003 and report["none", "absent"].tokens == 0 and report["r0", "big"].tokens == 0
    assert all(r.repeats <= 3 for r in rows) and len({(r.recipe, r.doc_id) for r in rows}) == len(rows)


def test_total_and_empty(spark):
    docs = [(i, "ab"[i % 2], 10) for i in range(1000)]
    _, report = mix(spark, docs, [("r", "a", 0.5, 1), ("r", "b", 0.5, 1)], total_tokens=1000)
    assert report["r", "a"].tokens == report["r", "b"].tokens == 500
    assert mix(spark, [], [("r", "a", 1.0, 1)])[0] == []


def test_token_counts(spark):
    path = f"{tokens.FOLDER}/{tokens.VOCABULARY}"
    long = "some words here " * 30_000
    assert tokens.count(long, path) == len(tokens._encoder(path).encode_ordinary(long))
    df = spark.createDataFrame([(1, "hello world", 3), (2, None, 3), (3, "", 3), (4, "<|endoftext|>", 3)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "doc_id").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_counts_are_of_whole_texts():
    path = f"{tokens.FOLDER}/{tokens.VOCABULARY}"
    whole = lambda t: len(tokens._encoder(path).encode_ordinary(t))
    for text in ("a " * 1500 + " " * 1500 + "b", "x" + "\n" * 2000, "x\t" + " " * 1200 + "\n y", "\n" * 1500 + "é", "x" + " " * 1000 + "\x1cy" + " " * 1001, "abc" * 100_000):
        assert tokens.count(text, path) == whole(text)
    assert tokens.count(" " * 1_000_000 + "x", path) > 1000


def test_most_containers_come_from_the_least_squares_plan(monkeypatch):
    rng = random.Random(3)
    histogram = Counter(min(8192, max(5, int(rng.lognormvariate(4.6, 1)))) for _ in range(10_000))
    used = sum(times for _, times in packing.plan(dict(histogram), 8192))
    monkeypatch.setattr(packing, "patterns", lambda *_: [])
    greedy = packing.plan(dict(histogram), 8192)
    assert used <= sum(times for _, times in greedy)
    monkeypatch.undo()
    counts = dict(histogram)
    columns = packing.patterns(counts, 8192)
    assert columns and all(8192 - 8192 * packing.WINDOW - 1 <= sum(a * n for a, n in c) <= 8192 and all(n <= counts[a] for a, n in c) for c in columns)
    x = packing.solve(columns, counts)
    assert (x >= 0).all() and x.sum() > 0.5 * used  # the solution itself serves most containers
