import json
from collections import defaultdict

from loomgraph.operators import drift
from loomgraph.session import table

FILES = "file_id long, series_id long, file_name string, run_no long, content string, field string"


def files(spark, contents, name="final-domains.json"):
    return spark.createDataFrame([(i, 1, name, i, c if c is None or isinstance(c, str) else json.dumps(c), "x") for i, c in enumerate(contents, 1)], FILES)


def found(spark, contents, name="final-domains.json"):
    return sorted((r.run_no, r.object_kind, r.change_kind, r.field, r.new_field) for r in drift.changes(files(spark, contents, name)).collect())


def test_rename_add_remove_retype(spark):
    a = [{"id": "d1", "label": "x", "old": 1, "n": None}, {"id": "d2", "label": "y", "n": "3"}]
    b = {"domains": {"d1": {"id": "d1", "title": "x", "n": 2}, "d2": {"id": "d2", "title": "changed", "fresh": [], "n": 3}}}
    assert found(spark, [a, b]) == [(2, "domain", "added", "fresh", ""), (2, "domain", "removed", "old", ""), (2, "domain", "renamed", "label", "title"), (2, "domain", "retyped", "n", "")]


def test_invalid_files_repeats_and_outer_form(spark):
    a = [{"id": "d", "label": "x"}]
    assert found(spark, [a, '[{"id": "d", "la', None, "null", {"d": {"id": "d", "label": "z"}}]) == []
    assert found(spark, [a, "{", [{"id": "d", "name": "x"}]]) == [(3, "domain", "renamed", "label", "name")]
    df = files(spark, [a, [{"id": "d", "name": "x"}]])
    assert drift.changes(df.union(df)).count() == 1
    assert found(spark, []) == []
    assert found(spark, [a, []]) == []


def test_place_and_nested_renames(spark):
    a = [{"id": "t", "steps": [{"node_id": "a"}, {"node_id": "b"}]}]
    b = [{"id": "t", "stops": {"1": {"node": "a"}, "2": {"node": "b"}}}]
    assert found(spark, [a, b], "final-tours.json") == [(2, "stop", "renamed", "node_id", "node"), (2, "tour", "added", "stops", ""), (2, "tour", "removed", "steps", "")]


def plain(before, after):
    """The rule of changes written out directly, without schema graphs."""
    out = []
    for kind in set(before.objects) & set(after.objects):
        old, new = before.objects[kind], after.objects[kind]
        if not old or not new:
            continue
        fields = [sorted({k for x in o.values() for k in x}) for o in (old, new)]
        gone, come = [f for f in fields[0] if f not in fields[1]], [f for f in fields[1] if f not in fields[0]]
        for f in list(gone):
            for g in list(come):
                both = [k for k in old if k in new and old[k].get(f) is not None]
                same = sum(json.dumps(old[k][f], sort_keys=True) == json.dumps(new[k].get(g), sort_keys=True) for k in both)
                if both and same * 2 >= len(both):
                    out.append((kind, "renamed", f, g))
                    gone.remove(f)
                    come.remove(g)
                    break
        out += [(kind, "removed", f, "") for f in gone] + [(kind, "added", g, "") for g in come]
        for f in set(fields[0]) & set(fields[1]):
            a, b = ({t for x in o.values() if f in x for t in drift.value_type(x[f])} for o in (old, new))
            if a and b and a != b:
                out.append((kind, "retyped", f, ""))
    return out


def test_against_the_rule_on_the_test_table(spark, sf):
    df = table(spark, sf, "assembly_files")
    by = defaultdict(dict)
    for r in df.collect():
        try:
            by[r.series_id, r.file_name][r.run_no] = drift.read_schema(json.loads(r.content), r.file_name)
        except ValueError:
            pass
    want = set()
    for (series, name), runs in by.items():
        order = sorted(runs)
        for p, n in zip(order, order[1:]):
            want |= {(series, n, name, *c) for c in plain(runs[p], runs[n])}
    got = {(r.series_id, r.run_no, r.file_name, r.object_kind, r.change_kind, r.field, r.new_field) for r in drift.changes(df).collect()}
    assert got == want and got


def test_flooding_scores_and_unified(spark):
    a = [{"id": "d", "label": "x", "summary": "s", "entities": ["e"]}]
    b = [{"id": "d", "name": "x", "about": "s", "entities": "e"}]
    one, two = drift.read_schema(a, "final-domains.json"), drift.read_schema(b, "final-domains.json")
    score = drift.flood(one, two, {("domain", "label", "name"): 1.0, ("domain", "summary", "about"): 1.0})
    assert score["domain", "label", "name"] > score["domain", "label", "about"]
    assert score["domain", "entities", "entities"] > score["domain", "entities", "name"]
    rows = drift.unified(files(spark, [a, b]), "domain").orderBy("run_no").collect()
    assert [(r.label, r.summary, r.entities) for r in rows] == [("x", "s", '["e"]'), ("x", "s", '["e"]')]


def test_the_flooded_score_chooses(monkeypatch):
    """Two new fields hold the old one's values: the likelier is its new name, not the first; a constant score can't tell."""
    one = drift.read_schema([{"id": "d", "stepTitle": "x"}, {"id": "e", "stepTitle": "y"}], "final-domains.json")
    two = drift.read_schema([{"id": "d", "alias": "x", "step_title": "x"}, {"id": "e", "alias": "y", "step_title": "y"}], "final-domains.json")
    assert [c[:4] for c in drift.compare(one, two)] == [("domain", "renamed", "stepTitle", "step_title"), ("domain", "added", "alias", "")]
    monkeypatch.setattr(drift, "flood", lambda before, after, values: dict.fromkeys(values, 0.5))
    assert [c[:4] for c in drift.compare(one, two)] == [("domain", "renamed", "stepTitle", "alias"), ("domain", "added", "step_title", "")]


def test_many_renames_and_two_fields_of_one_name(spark):
    runs = [[{"id": "d", name: "x", "k": 1}] for name in ("label", "l1", "l2", "l3", "l4", "l5")]
    rows = drift.unified(files(spark, runs), "domain").collect()
    assert [r.label for r in rows] == ["x"] * 6
    both = [[{"id": "d", "label": "x"}], [{"id": "d", "title": "x"}], [{"id": "d", "title": "b", "label": "a"}]]
    last = drift.unified(files(spark, both), "domain").where("run_no = 3").first()
    assert last.label == "a" and last.others == {"id": "d", "title": "b"}
