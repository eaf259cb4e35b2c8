import math

from loomgraph.llm import distinctive

KEYS = ["project", "node_id"]
NODES = "project string, id string, label string, summary string, ord long, term string, tf int"


def test_scores_versions_and_ties(spark):
    rows = [
        ("p", "file:file:a", "Old", "old old", 1, "", 0), ("p", "file:a", "Über x1", "rare rare common", 2, "", 0), ("p", "file:a", "Über x1", "rare rare common", 2, "", 0),
        ("p", "file:b", None, "common RARE", 3, "", 0), ("q", "file:a", "common", None, 4, "", 0), ("q", "file:c", None, None, 5, "", 0), ("q", "file:d", "über", "…—_!", None, "", 0),
    ]
    recs = distinctive.node_records(spark.createDataFrame(rows, NODES))
    got = {(r.project, r.node_id, r.term): r for r in distinctive.scores(recs, KEYS).collect()}
    assert ("p", "file:a", "old") not in got and len({k[:2] for k in got}) == 4
    r = got["p", "file:a", "rare"]
    assert (r.tf, r.df, r.cf) == (2, 2, 3) and abs(r.tf_idf - 2 * math.log(5 / 2)) < 1e-9
    assert abs(r.score - 2 * (math.log(5 / 2) + math.log(1 - math.exp(-3 / 5)))) < 1e-9
    assert got["q", "file:d", "über"].df == 2
    top = distinctive.top_terms(distinctive.scores(recs, KEYS, least_df=2), KEYS, "tf_idf", 2).where("project = 'p' and node_id = 'file:a'").orderBy("rank").collect()
    assert [t.term for t in top] == ["rare", "über"]


def test_hot_terms_and_long_texts(spark):
    rows = [("p", f"n{i}", "the", "the " * (20_000 if i == 0 else 1), i, "", 0) for i in range(50)]
    scored = distinctive.scores(distinctive.node_records(spark.createDataFrame(rows, NODES)), KEYS)
    assert scored.count() == 50 and scored.agg({"tf": "max"}).first()[0] == 20_001


def test_empty(spark):
    assert distinctive.scores(distinctive.node_records(spark.createDataFrame([], NODES)), KEYS).count() == 0


def test_chosen_where_the_record_lies(spark, monkeypatch):
    """Few or no terms broadcast give the same result as all of them."""
    rows = [("p", f"n{i}", f"w{i % 7} w{i % 11} both", f"w{i % 3} only{i} " + "x" * 300, i, "", 0) for i in range(60)]
    recs = distinctive.node_records(spark.createDataFrame(rows, NODES))
    want = sorted(map(tuple, distinctive.top_terms(distinctive.scores(recs, KEYS, least_df=2), KEYS, "score").select(*KEYS, "rank", "term", "df", "score").collect()))
    for bound in (32_768, 3, 1):
        monkeypatch.setattr(distinctive, "FREQUENT", bound)
        got = distinctive.characteristic(recs, KEYS, "score", least_df=2)
        assert sorted(map(tuple, got.select(*KEYS, "rank", "term", "df", "score").collect())) == want
