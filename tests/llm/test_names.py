import itertools

import pytest

from loomgraph.llm import names

CANON = "Wilhelmina Kiskrakishun"


@pytest.mark.parametrize(
    "seen",
    ["WILHELMINA KISKRAKISHUN", "Kiskrakishun, Wilhelmina", "KISKRAKISHUN Wilhelmina", "W. Kiskrakishun", "Kiskrakishun, W.", "wkiskrakishun", "Wilhelmina  Kiskrakishun",
     "wilhelmina.kiskrakishun", "Mina Kiskrakishun", "Wilhelmina K. Kiskrakishun", "Wilhelmina Kiskrakihsun", "Wilhelmina K.", "Kiskrakishun", "Wilhelmina Kiskrakishun (ext)",
     "Wilhelmina Kiskrakishun <w@x.example>", "wilhelminakiskrakishun", "Wilhelnina Kskrakishun"],
)
def test_channel_reaches_variants(seen):
    assert names.channel_cost(seen, CANON) <= names.MAX_COST
    assert names.keys(seen)[1] & names.keys(CANON)[0]


@pytest.mark.parametrize("seen", ["Santiago Kiskrakishun", "Wilhelmina Tumwesnovvud", "S. Kiskrakishun", "Kiskrakishun Software Inc", "skiskrakishum"])
def test_channel_keeps_others_apart(seen):
    assert names.channel_cost(seen, CANON) > names.MAX_COST


def test_organisations():
    for seen in ("Gosmigbra Tooling", "GOSMIGBRA Tooling Inc", "Gosmigbra Too. Inc", "Tooling Gosmigbra", "GosmigbraTooling Inc", "gosmigbra-tooling", "Gosmigbra Tooling, Inc."):
        assert names.channel_cost(seen, "Gosmigbra Tooling Inc") <= names.MAX_COST, seen
        assert names.keys(seen)[1] & names.keys("Gosmigbra Tooling Inc")[0], seen
    assert names.channel_cost("Gosmigbra Labs Inc", "Gosmigbra Tooling Inc") > names.MAX_COST


def test_given_names_of_two_words():
    for seen in ("Eun Ji M.", "Mordimpas, Eun Ji", "emordimpas", "eun ji.mordimpas", "EUN JI MORDIMPAS"):
        assert names.channel_cost(seen, "Eun Ji Mordimpas") <= names.MAX_COST, seen
        assert names.keys(seen)[1] & names.keys("Eun Ji Mordimpas")[0], seen


def test_edits():
    assert [names.edits(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abcd", "badc"), ("abc", "xyz"))] == [0, 1, 1, 2, 3]


def commits(spark, rows):
    return spark.createDataFrame(rows, "commit_id long, project string, author string, canonical string")


def git(spark, rows=()):
    return spark.createDataFrame(list(rows), "project string, node_id string, primary_authors array<string>")


def test_groups_and_pairs(spark):
    rows = [(i, "p", CANON, "") for i in range(9)] + [(9, "p", "W. Kiskrakishun", ""), (10, "p", "", ""), (11, "p", None, ""), (12, None, CANON, ""), (13, "q", "W. Kiskrakishun", ""), (9, "p", "W. Kiskrakishun", "")]
    got = names.pairs(names.attach(names.spellings(commits(spark, rows), git(spark, [("p", "n", ["Mina Kiskrakishun", None, ""]), ("p", "m", None)]))))
    assert sorted(tuple(r) for r in got.collect()) == [("p", "Mina Kiskrakishun", "W. Kiskrakishun"), ("p", "Mina Kiskrakishun", CANON), ("p", "W. Kiskrakishun", CANON)]


def test_ambiguous_and_empty(spark):
    rows = [(i, "p", n, "") for i, n in enumerate(["Viktor Tumlix"] * 3 + ["Viktor Talbra"] * 3 + ["Viktor T.", "x" * 5000, "?!", "<>"])]
    got = {r.name: r.canonical for r in names.attach(names.spellings(commits(spark, rows), git(spark))).collect()}
    assert got["Viktor Tumlix"] != got["Viktor Talbra"] and len(got) == 6
    assert names.attach(names.spellings(commits(spark, []), git(spark))).count() == 0


def test_spellings_of_one_person_do_not_compete(spark):
    full = ["Giovanni Quigrukis"] * 7 + ["Quigrukis, Giovanni"] * 4 + ["GIOVANNI QUIGRUKIS"] * 4 + ["QUIGRUKIS Giovanni"] * 3
    rows = [(i, "p", n, "") for i, n in enumerate(full + ["giovanni.quigrukis", "Viktor Tumlix", "Viktor Talbra", "Viktor Tosko", "Viktor T."])]
    got = {r.name: r.canonical for r in names.attach(names.spellings(commits(spark, rows), git(spark))).collect()}
    assert {got[n] for n in full + ["giovanni.quigrukis"]} == {"Giovanni Quigrukis"}
    assert got["Viktor T."] == "Viktor T."  # three different persons


@pytest.mark.parametrize("a, b", [("Sarah Kahn", "Sarah Khan"), ("Sarah Lee", "Sarah Leo"), ("Sarah Lee", "Sarah Leex"), ("Sarah Johnson", "Sarah Jahnsen"), ("Sarah Wallace", "Sarah Wolluce"), ("Jan Van Dyke", "Jan Vandyke")])
def test_short_family_names_meet(a, b):
    assert names.channel_cost(a, b) <= names.MAX_COST
    assert names.keys(a)[1] & names.keys(b)[0]


def test_pet_forms_are_learned_from_shared_families(spark):
    """Forms no list holds: Quonzel and Mip stand with the same families, Quonzel and Brunt with one by chance."""
    families = [f"{a}{b}ter" for a in ("Ka", "Lo", "Mu", "Ni") for b in ("bris", "dolm", "fenk")]
    rows = [(f"Quonzel {f}", f"Mip {f}") for f in families] + [("Brunt Kabrister", "Brunt Osterwall")]
    rows = [(i, "p", n, "") for i, n in enumerate(x for pair in rows for x in pair)]
    rows += [(100 + i, "p", f"{g} {f}", "") for i, (g, f) in enumerate((g, f) for w in ("".join(x) for x in itertools.product("bdgkl", "aeiou", "mnr")) for g, f in ((f"Gor{w}", f"Fam{w}"), (f"Hel{w}", f"Fam{w}")))]
    spelled = names.spellings(commits(spark, rows), git(spark))
    pets = names.learned(spelled)
    assert pets["mip"] == {"quonzel"} and "brunt" not in pets and names.channel_cost("Mip Osterwall", "Quonzel Osterwall", pets) <= names.MAX_COST
    got = {r.name: r.canonical for r in names.attach(spelled).collect()}
    assert all(got[f"Mip {f}"] == got[f"Quonzel {f}"] for f in families)


def test_long_names_have_typos_too():
    a = "Anna " + "wolkenstein" * 12
    for b in (a[:40] + "x" + a[40:], a[:60] + a[61] + a[60] + a[62:], a[:100] + a[102:]):
        assert names.channel_cost(b, a) <= names.MAX_COST and names.keys(b)[1] & names.keys(a)[0]
        glued = b.replace(" ", "").lower()
        if names.channel_cost(glued, a) <= names.MAX_COST:
            assert names.keys(glued)[1] & names.keys(a)[0]


@pytest.mark.parametrize("seen, meant", [("Hank Miller", "Henry Miller"), ("Chuck Miller", "Charles Miller"), ("Gus Miller", "August Miller"), ("Toni Miller", "Antonia Miller"), ("Sepp Huber", "Josef Huber")])
def test_general_pet_forms(seen, meant):
    assert names.channel_cost(seen, meant) <= names.MAX_COST and names.keys(seen)[1] & names.keys(meant)[0]


def test_keys_cover_the_channel():
    """Whatever two edits of a family and one of a given name make, the keys meet."""
    import random

    r = random.Random(4)
    for _ in range(400):
        given = "".join(r.choices("aeioulmnrst", k=r.randrange(2, 9))).capitalize()
        family = "".join(r.choices("abcdefghijklmnoprstuvwz", k=r.randrange(3, 30))).capitalize()
        seen = f"{given} {family}"
        words = [given, family]
        for k, times in ((0, r.randrange(2)), (1, r.randrange(3))):
            for _ in range(times):
                w, i = words[k], r.randrange(len(words[k]))
                words[k] = r.choice([w[:i] + "q" + w[i:], w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])
        made = " ".join(words)
        if names.channel_cost(made, seen) <= names.MAX_COST:
            assert names.keys(made)[1] & names.keys(seen)[0], (made, seen)


def written(spark, pairs):
    """One project's spellings of (given, family) pairs."""
    return spark.createDataFrame([("p", f"{g.capitalize()} {f.capitalize()}", 1) for g, f in pairs], "project string, name string, n long")


def word(i):
    """A word of its own for each number; neighbours differ by more than typos."""
    out, i = "", i * 7919 % 810_000
    for _ in range(4):
        i, a = divmod(i, 30)
        out += "bdfgklmnprstvwz"[a % 15] + "ai"[a // 15] + "x"
    return out


def test_every_learned_pet_form_is_kept(spark):
    """More pairs than a fixed number, each with three families of its own."""
    many = 5_200
    pairs = [(given, f"{word(i)}ha{end}") for i in range(many) for end in ("mo", "ru", "le") for given in (f"qu{word(i)}", f"o{word(i)}zel")]
    pets = names.learned(written(spark, pairs))
    assert sum(f"o{word(i)}zel" in pets.get(f"qu{word(i)}", ()) for i in range(many)) == many


def test_pet_forms_are_learned_from_large_families_too(spark):
    """Families of more than LEARN_GIVEN given names count as well, the less the larger they are."""
    pairs = [(g, f"{word(i)}hamo") for i in range(30) for g in ["quonzel", "mip"] + [f"a{word(100 + 14 * i + j)}" for j in range(14)]]
    pairs += [(f"e{word(i)}", f"{word(j)}hamo") for j in range(30, 330) for i in (2 * j, 2 * j + 1)]
    spelled = written(spark, pairs)
    assert names.learned(spelled)["mip"] == {"quonzel"}
    spelled = spelled.union(spark.createDataFrame([("p", "Quonzel Osterwall", 3), ("p", "Mip Osterwall", 1), ("p", "Brunt Osterwall", 1)], spelled.schema))
    got = {r.name: r.canonical for r in names.attach(spelled).collect()}
    assert got["Mip Osterwall"] == "Quonzel Osterwall" and got["Brunt Osterwall"] == "Brunt Osterwall"


def test_common_given_names_that_meet_by_chance_are_not_forms(spark):
    import random

    r = random.Random(2)
    pool = [f"a{word(i)}" for i in range(40)]
    pairs = [(g, f"{word(500 + i)}hamo") for i in range(60) for g in r.sample(pool, 20)]
    assert names.learned_pairs(written(spark, pairs)).count() == 0


def test_learning_by_prefixes_is_exact(spark):
    """The same pairs as by comparing all given names with each other."""
    import math
    import random
    from collections import defaultdict

    r = random.Random(5)
    pairs = {(f"a{word(g)}", f"{word(900 + f)}hamo") for f in range(120) for g in r.sample(range(300), r.choice([1, 2, 3, 6, 12, 40]))}
    for x, y in ((1, 2), (3, 4), (5, 6)):  # forms of one name: most families of either hold both
        pairs |= {(f"a{word(z)}", f"{word(900 + f)}hamo") for f in r.sample(range(120), 25) for z in (x, y)}
    both_orders = pairs | {(f, g) for g, f in pairs}
    families, of = defaultdict(set), defaultdict(set)
    for g, f in both_orders:
        families[f].add(g)
        of[g].add(f)
    weight = {f: min(1, names.LEARN_GIVEN / len(gs)) for f, gs in families.items() if len(gs) > 1}
    every = {g: sum(weight.get(f, 0) for f in fs) for g, fs in of.items()}
    want = set()
    for a, b in itertools.permutations(of, 2):
        if (every[a], a) < (every[b], b):
            both = sum(weight.get(f, 0) for f in of[a] & of[b])
            limits = []
            for x, y in ((a, b), (b, a)):
                p = {f: 1 - (1 - len(of[y]) / len(pairs)) ** len(families[f]) for f in of[x] if f in weight}
                limits.append(sum(weight[f] * p[f] for f in p) + names.LEARN_SIGMAS * math.sqrt(sum(weight[f] ** 2 * p[f] for f in p)))
            short, full = sorted((a, b), key=lambda x: (len(x), x))
            if both >= max(names.LEARN_LEAST, names.LEARN_SHARE * every[a], *limits) and names._given(short, full, names.FULL_FORMS) == math.inf:
                want.add((short, full))
    assert len(want) >= 3
    assert {tuple(x) for x in names.learned_pairs(written(spark, sorted(pairs))).collect()} == want
