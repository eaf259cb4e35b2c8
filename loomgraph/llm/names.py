"""Variant spellings of names typed by people, linked by noisy-channel attribution.

Each distinct spelling of a scope is read as given and family parts (for organisations: kind and stem) in every
order it may stand in. Full, frequent spellings are the candidate canonical forms. A spelling meets the candidates
that could have produced it through shared keys: the family part and its deletion neighbourhood with the given
initial, glued account forms, and given part with family initial. Each pair gets the log likelihood of the
channel (typos, abbreviations, nicknames, order, case, accents) and the candidate's log frequency as prior. Candidates
that have come to one root are one person: their posteriors are summed, and every spelling is attached to the root
of the largest sum, or stays on its own. This is repeated until no spelling changes its root.

Pet forms come from a short general list and from the data: two given names that stand with the same family names far
more often than chance are forms of one name (learned_pairs()). All of them are used; each spelling is joined with those
of its own given names.

Work is on distinct spellings, counted map-side. Hashed keys of all of them are shuffled once, a spelling that offers
and seeks under one key as one row, and met in a sorted stream in bounded steps; pairs are scored once. The roots are
found by joins, so no scope is gathered in one task.

Defined results
 * Null and blank spellings are left out, and so are rows without a scope. Repeated rows only add to the counts.
 * Ties in the posterior go to the root with the more frequent candidate, then to the smaller by code point.
 * Spellings are compared whole, whatever their length; parts of more than LONG letters meet by their fifths, one of which
   two edits leave as it is.
 * Where the first letter of a given name is wrong there is no other typo in the name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import ChainMap
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, salted_join

LONG = 24
#: Learned pet forms of one spelling.
PETS = "array<struct<short:string,full:array<string>>>"
#: Learning of pet forms: every family of two given names or more counts, one of up to LEARN_GIVEN as 1 and a larger one as
#: LEARN_GIVEN / its size; a pair must share a weight of LEARN_LEAST and a share LEARN_SHARE of the rarer name's, and be
#: LEARN_SIGMAS deviations above what chance gives.
LEARN_GIVEN, LEARN_LEAST, LEARN_SHARE, LEARN_SIGMAS = 8, 3, 0.2, 4.0
#: Short and pet forms of given names, folded.
NICKNAMES = """
abigail abby gail|agnes agi aggie|albert al bert bertie|alexander alex sasha sascha lex xander sandro sandy|alfred alf alfie fred|alice ali ally|amanda mandy|anastasia ana nastya stacy nastia tasia|andrew andy drew
anna anne annie anja anouk|anne-sophie annso anso|anthony tony|antonia toni|antonio toni tonio|archibald archie|arthur art artie|august gus gustl|barbara barb babs|bartholomew bart|beatrice bea trixie|benedict ben
benjamin ben benny benni|bernard bernie|bjorn bjoern|caroline carol carrie line|catherine cat cathy kate katie kit|charles charlie chuck chas carl|charlotte charlie lotte lottie lotta|chloe clo|christina chris tina chrissy
christopher chris kit topher|clement clem|cornelius neil con|daniel dan danny|david dave davy|deborah deb debbie|dimitri dima mitya dmitri dimi|dolores lola lolita loli|dominic dom nic|donald don donny|dorothy dot dolly
edmund ed ned|edward ed ted eddie teddy ned|eleanor nell nora ellie|elizabeth liz beth lizzie betty eliza lisa bess|emily em emmy milly|emmanuel manu manny|ernest ernie|eugene gene|eun-ji ej|florence flo flora
frances fran fanny franny|francis frank fran|francisco paco pancho fran cisco|francoise fanny franny|franziska franzi ziska|frederick fred fritz freddie rick|friedrich fritz fiete|gabriel gabe|geoffrey geoff jeff
gerald gerry jerry|gerhard gerd|gertrude trudy gert|giovanni gianni vanni gio nanni|giuseppe beppe pino peppe|gregory greg|guillermo memo|gustav gus|harold harry hal|harriet hattie harry|heinrich heinz heiner
helen nell nellie lena|henry hank harry hal|herbert herb bert|hubert hugh bert|ignacio nacho iggy|ilse ilsa|isabella bella izzy isa|jacob jake jack|jacqueline jackie|james jim jimmy jamie|jean-luc jl jeannot
jeffrey jeff|jennifer jen jenny|jeremy jerry jem|jesus chucho|joachim jochen achim|johannes hannes hans jo johan|john jack johnny|jonathan jon|jose pepe jos chepe|josef sepp joe jupp|joseph joe joey|joshua josh
judith judy|julia jules|jurgen jogi jurg|karl kalle|katharina kathi kat kathy kate katja kati|kenji ken|kenneth ken kenny|konrad conny kurt|lawrence larry laurie|leonard len lenny leo|leonardo leo nardo|louis lou louie
lucia lucy|ludwig lutz|luis lucho|lukasz luk lukas|magdalena lena magda maggie|manuel manolo manu|marcus marc mark|maren mari|margaret maggie peg peggy meg greta daisy|maria mary mia mitzi|marianne nanni|martha patty
martin marty|matilda tilda tilly|matthew matt matty|maximilian max|melissa mel|michael mike mischa mick micha misha|mikhail misha|natalia natasha nat talia|nathaniel nat nate|ngozi ngo|nicholas nick nicky
nikolai kolya nik nick niko nikolay|oliver ollie|oluwaseun seun olu|oswald ozzie|pal paal|pamela pam|patricia pat trish patsy|patrick pat paddy|penelope penny nell|peter pete|philip phil pip|priya pri|rafael rafa
raymond ray|rebecca becky|reinhard reiner|rene ren|ricardo rico ricky|richard rick dick rich ricky|robert rob bob bobby bert robbie|roberto beto|roland rolf|ronald ron ronnie|rosalind roz rosie|rudolf rudi
samuel sam sammy|santiago santi chago diego|sebastian seb basti wastl|sigmund siggi|sophia sophie fia|soren sorn|stanislav stas slava|stephanie steffi steph stef fanny|stephen steve|susan sue suzy|sylvester sly
tariq taz|theodora thea dora theo teddy|theodore ted theo teddy|theresa tess terry resi|thomas tom tommy|timothy tim|tomas tom tommy|ulrich uli ully|ursula uschi ulla ursel|valentina tina vale|victor vic
victoria vicky tori|viktor vik vic vitya|vincent vince vinnie|vladimir vova volodya|walter walt wally|wilhelm willi helmut|wilhelmina mina willa minnie helma wilma|william will bill billy willy liam|yasmin yas mina
yevgeny zhenya|zachary zach|zoe zo
""".strip().replace("\n", "|")  # fmt: skip
#: Words for what an organisation does, and legal forms.
ORG_WORDS = {"software", "tooling", "labs", "lab", "systems", "analytics", "technologies", "technology", "solutions", "consulting", "group", "foundation", "works", "studio", "studios", "services", "networks", "research", "data", "digital", "media", "partners", "industries", "holdings", "team"}
LEGAL = {"inc", "ltd", "llc", "gmbh", "ag", "ab", "sarl", "sa", "sas", "bv", "nv", "oy", "as", "aps", "spa", "srl", "plc", "corp", "co", "company", "limited", "incorporated", "corporation", "kg", "ug", "pty"}
#: Channel costs in nats.
COSTS = {"edit": 3.0, "nickname": 2.0, "initial": 2.0, "family_only": 3.0, "family_initial": 4.0, "glued": 1.0, "reorder": 0.5, "abbreviation": 1.5, "prefix": 2.5, "one_org": 1.0}
#: A spelling stays on its own when every candidate costs more, or no root holds this share of the posterior.
MAX_COST, MIN_SHARE = 10.0, 0.5
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})


_WIDE = re.compile(r"[^\x00-\x7f]")


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFKD", _letters(text.lower()))
    return _letters(_WIDE.sub(lambda m: "" if unicodedata.combining(m.group()) else m.group(), plain))


def _letters(text: str) -> str:
    return text.translate(_LETTERS) if any(c in text for c in "łøđðþæœßı") else text


def _full_forms() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for group in NICKNAMES.split("|"):
        full, *short = [w.replace("-", "") for w in group.split()] or [""]
        for s in short:
            out.setdefault(s, set()).add(full)
    return out


FULL_FORMS = _full_forms()


@lru_cache(maxsize=100_000)
def read(name: str) -> tuple[bool, bool, tuple[tuple[str, str], ...], str, str]:
    """(is an organisation, is a full form, readings (given or kind, family or stem), glued letters, kind of form)."""
    text = re.sub(r"<[^>]*>|\([^)]*\)|\[[^\]]*\]", " ", name).strip()
    if not text:
        text = name
    text = re.sub(r"@.*$", "", text.strip())
    glued = re.sub(r"[\W_\d]", "", fold(text))
    comma = [p.strip() for p in text.split(",")]
    split_case = re.sub(r"(?<=[a-zß-ÿ]{3})(?=[A-Z])", " ", text)
    words = [w for w in re.split(r"[\s.,_/]+|(?<=\w{3})-(?=(?:" + "|".join(sorted(ORG_WORDS)) + r")\b)", fold(split_case)) if w]
    bare = [w for w in words if w not in LEGAL]
    has_legal = len(bare) < len(words) and len(bare) > 0
    kinds = [w for w in bare if w in ORG_WORDS]
    if has_legal and not kinds and len(bare) >= 2:
        kinds = [w for w in bare[1:] if 2 <= len(w) <= 4 and any(o.startswith(w) for o in ORG_WORDS)]
    if kinds and len(bare) > len(kinds) or has_legal and len(bare) <= 2 and re.search(r"(?i)\b(?:inc|ltd|llc|gmbh|corp|sarl|plc)\b", text):
        stem = "".join(re.sub(r"\W", "", w) for w in bare if w not in kinds)
        return True, bool(kinds), (("".join(kinds), stem),), glued, "org"
    tokens = [re.sub(r"[\W_\d]", "", w) for w in re.split(r"[\s._/]+", fold(text.replace(",", " "))) if re.sub(r"[\W_\d]", "", w)]
    if len(tokens) == 0:
        return False, False, (), glued, "none"
    if len(comma) == 2 and comma[0] and comma[1]:
        family = re.sub(r"[\W_\d]", "", fold(comma[0]))
        given = [re.sub(r"[\W_\d]", "", w) for w in re.split(r"[\s.]+", fold(comma[1])) if re.sub(r"[\W_\d]", "", w)]
        long = [g for g in given if len(g) > 1]
        joined = "".join(long) if long else "".join(given[:1])
        return False, len(joined) > 1 and len(family) > 1, ((joined, family),), glued, "comma"
    long = [t for t in tokens if len(t) > 1]
    if len(tokens) == 1:
        t = tokens[0]
        return False, False, (("", t), (t[0], t[1:])) if len(t) > 5 else (("", t),), glued, "single"
    if len(long) >= 2 and len(tokens[-1]) == 1 and len(tokens) == len(long) + 1 and max(map(len, long)) <= 6:
        return False, False, (("".join(long), tokens[-1]), (tokens[-1], "".join(long))), glued, "family initial"
    if len(long) >= 2:
        readings = (("".join(long[:-1]), long[-1]), ("".join(long[1:]), long[0]))
        return False, True, readings, glued, "full"
    if len(long) == 1:
        if len(tokens[-1]) == 1:
            return False, False, ((long[0], tokens[-1]), (tokens[-1], long[0])), glued, "family initial"
        return False, False, ((tokens[0], long[0]),), glued, "initial"
    return False, False, (), glued, "none"


def near(text: str, deletions: int) -> set[str]:
    """The text with up to so many letters left out."""
    out = level = {text}
    for _ in range(deletions):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out = out | level
    return out


def _fifths(text: str, most: int) -> tuple[set[str], set[str]]:
    """(parts to offer, parts to seek) of a long text: its five parts, and what may be a part of a text within so many
    edits. Two edits, swaps of neighbours included, touch four parts at most."""
    n = len(text)

    def bounds(size):
        return [(k, k * size // 5, (k + 1) * size // 5) for k in range(5)]

    offers = {f"{n}.{k}.{text[a:b]}" for k, a, b in bounds(n)}
    seeks = {f"{size}.{k}.{text[a + d : b + d]}" for size in range(max(5, n - most), n + most + 1) for k, a, b in bounds(size) for d in range(-most, most + 1) if 0 <= a + d and b + d <= n}
    return offers, seeks | offers


def _typos(text: str) -> tuple[set[str], set[str]]:
    """(keys to offer, keys to seek) that texts as near as _typo() allows share."""
    most = 2 if len(text) >= 7 else 1 if len(text) >= 3 else 0
    if len(text) > LONG:
        return _fifths(text, most)
    both = near(text, most)
    if len(text) > LONG - most:  # a partner may be long
        a, b = _fifths(text, most)
        return both | a, both | b
    return both, both


def keys(name: str, pets: dict[str, set[str]] | None = None) -> tuple[set[str], set[str]]:
    """(keys under which the spelling is met as a candidate, keys under which it looks for candidates)."""
    pets = FULL_FORMS if pets is None else pets
    org, full, readings, glued, form = read(name)
    offers: set[str] = set()
    seeks: set[str] = set()
    for i, (g, f) in enumerate(readings):
        if not f or form == "family initial" and len(f) == 1:
            continue
        initials = [""] if org else {g[:1]} | {x[:1] for x in pets.get(g, ())}
        mark = "o" if org else "p"
        own, sought = ({f"{mark}{c}~{d}" for c in initials for d in part} for part in _typos(f))
        if org:
            own.add(f"o={f}")
            sought.add(f"o={f}")
        elif len(g) > 1:  # the first letter of the given name may be wrong
            turned = {f"p={f}.{x}" for x in (g, g[1:], g[:1] + g[2:])}
            own |= turned
            sought |= turned
        if full and (i == 0 or org):
            offers |= own
            offers.add(f"p={f}")
            if not org:
                offers |= {f"g~{d}" for x in (g + f, f + g) for d in _typos(x)[0] if len(x) > LONG or len(d) >= len(x) - 1}
                offers.add(f"i={g}.{f[0]}")
        seeks |= sought
        if not g:
            seeks.add(f"p={f}")
    if full:  # spellings of the same letters, divided otherwise
        same = f"{'o' if org else 'p'}g={glued}"
        offers.add(same)
        seeks.add(same)
    if form == "single":
        seeks |= {f"g~{d}" for d in _typos(glued)[1] if len(glued) > LONG or len(d) >= len(glued) - 1 or "." in d}
        seeks.add(f"o={glued}")
    if form == "family initial":
        g, f = readings[0]
        seeks |= {f"i={x}.{f}" for x in {g} | pets.get(g, set())}
    return offers, seeks


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between a and b, most + 1 when more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
    return row[-1]


def _typo(a: str, b: str) -> float:
    shorter = min(len(a), len(b))
    most = 2 if shorter >= 7 else 1 if shorter >= 3 else 0
    n = edits(a, b, most)
    return COSTS["edit"] * n if n <= most else math.inf


def _given(seen: str, meant: str, pets: dict[str, set[str]]) -> float:
    """Cost of writing one given name for another."""
    if seen == meant:
        return 0.0
    mine, theirs = pets.get(seen, frozenset()), pets.get(meant, frozenset())
    if len(seen) == 1 or len(meant) == 1:
        initials = {seen[:1]} | {x[:1] for x in mine}
        return COSTS["initial"] if meant[:1] in initials or seen[:1] == meant[:1] else math.inf
    cost = _typo(seen, meant)
    if seen[:1] != meant[:1] and cost > COSTS["edit"]:
        cost = math.inf
    if meant in mine or seen in theirs or mine & theirs:
        cost = min(cost, COSTS["nickname"])
    elif len(seen) >= 3 and meant.startswith(seen) or len(meant) >= 3 and seen.startswith(meant):
        cost = min(cost, COSTS["prefix"])
    else:
        full = min((_typo(x, meant) for x in mine if x[:1] == meant[:1]), default=math.inf)
        cost = min(cost, COSTS["nickname"] + full)
    return cost


def channel_cost(seen: str, meant: str, pets: dict[str, set[str]] | None = None) -> float:
    """-log P(the spelling seen | the canonical spelling meant), infinite when the channel can't make it."""
    pets = FULL_FORMS if pets is None else pets
    so, _, sr, sg, sform = read(seen)
    mo, mfull, mr, mg, _ = read(meant)
    if not mfull or not mr:
        return math.inf
    if sg == mg and so == mo:
        return 0.2
    best = math.inf
    if mo:
        kind, stem = mr[0]
        for k, s in sr:
            if so:
                about = 0.0 if k == kind else COSTS["one_org"] if not k else COSTS["abbreviation"] if kind.startswith(k) or k.startswith(kind) else _typo(k, kind)
                best = min(best, about + _typo(s, stem))
            elif sform == "single" and not k:
                best = min(best, COSTS["family_only"] + _typo(s, stem), COSTS["glued"] + _typo(sg, stem + kind))
        return best
    if so:
        return math.inf
    g, f = mr[0]
    if sform == "single":
        best = min(best, COSTS["glued"] + _typo(sg, g + f), COSTS["glued"] + COSTS["reorder"] + _typo(sg, f + g))
        best = min(best, COSTS["glued"] + COSTS["initial"] + _typo(sg[1:], f) if sg[:1] == g[:1] else math.inf)
        if _typo(sg, f) < _typo(sg[1:], f):  # else the first letter is an initial, and not this person's
            best = min(best, COSTS["family_only"] + _typo(sg, f))
        return best
    for i, (a, b) in enumerate(sr):
        turned = COSTS["reorder"] if i else 0.0
        if len(b) == 1:
            if b == f[:1]:
                best = min(best, turned + COSTS["family_initial"] + _given(a, g, pets))
            continue
        if b == f or {a[:1], *(x[:1] for x in pets.get(a, ()))} & {g[:1], *(x[:1] for x in pets.get(g, ()))}:
            best = min(best, turned + _typo(b, f) + _given(a, g, pets))
    return best


def spellings(commits: DataFrame, file_git: DataFrame) -> DataFrame:
    """(project, name, n): the distinct spellings and how often each is used; repeated commit rows count once."""
    typed = commits.select("project", "commit_id", F.col("author").alias("name")).distinct().select("project", "name")
    listed = file_git.select("project", "node_id", F.explode("primary_authors").alias("name")).distinct().select("project", "name")
    return (
        typed.unionByName(listed).where(F.col("project").isNotNull() & (F.col("name") != ""))
        .groupBy("project", "name").agg(F.count(F.lit(1)).alias("n"))
    )


def _families(batches):
    """project, name -> project, family, given of the full forms of persons."""
    schema = pa.schema([("project", pa.string()), ("family", pa.string()), ("given", pa.string())])
    for b in batches:
        out = []
        for project, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            org, full, readings, _, _ = read(name)
            if full and not org:
                out += [(project, f, g) for g, f in readings if len(g) > 1 and len(f) > 2]
        if out:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def _unexplained(batches):
    """Pairs (short, full) that the general list, typos and shortening don't explain."""
    for b in batches:
        keep = [_given(x, y, FULL_FORMS) == math.inf for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_()))


def learned_pairs(names: DataFrame) -> DataFrame:
    """(short, full): the given names that share family names beyond chance and that nothing else explains.

    A family of k given names holds another one, used q of all times, with the chance 1 - (1 - q)^k. The weight that two
    names share is compared with the sum of these chances over the families of the one and over those of the other. A
    pair must share a weight of LEARN_LEAST and LEARN_SHARE of the rarer name's, so the rarer name's largest families with
    less than that together make no candidates (prefix filtering, exact), and names of less weight none at all."""
    each = cut(names.select("project", "name").mapInArrow(_families, "project string, family string, given string").distinct())
    # names read in both orders count once
    total = each.select("project", F.least("family", "given").alias("x"), F.greatest("family", "given").alias("y")).distinct().count()
    sizes = each.groupBy("project", "family").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    weight = F.least(F.lit(1.0), F.lit(float(LEARN_GIVEN)) / F.col("k")).cast("decimal(18,12)")  # exact sums, whatever their order
    held = each.join(sizes, ["project", "family"]).select("project", "family", "given", "k", weight.alias("w"))
    used = each.groupBy("given").agg((F.count(F.lit(1)) / F.lit(float(max(1, total)))).alias("q"))
    classes = held.groupBy("given", "k", "w").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("cw"))
    need = F.greatest(F.lit(LEARN_LEAST).cast("double"), LEARN_SHARE * F.col("all").cast("double")).cast("decimal(30,12)")
    strong = classes.groupBy("given").agg(F.sum("cw").cast("decimal(30,12)").alias("all")).where(F.col("all") >= LEARN_LEAST)
    strong = cut(strong.withColumn("need", need).join(used, "given"))
    classes = cut(classes.join(strong.select("given", "need"), "given"))
    held = cut(held.join(strong.select("given", "all"), "given"))
    larger = Window.partitionBy("given").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = classes.withColumn("so_far", F.sum("cw").over(larger)).where("so_far >= need").select("given", "k")
    a = held.join(prefix, ["given", "k"]).select("project", "family", F.col("given").alias("a"), F.col("all").alias("wa"))
    b = held.select("project", "family", F.col("given").alias("b"), F.col("all").alias("wb"))
    met = a.join(b, ["project", "family"]).where("wa < wb OR wa = wb AND a < b").select("a", "b").distinct()
    shared = met.join(held.select("project", "family", F.col("given").alias("a"), "w"), "a").join(b.drop("wb"), ["project", "family", "b"])
    shared = shared.groupBy("a", "b").agg(F.sum("w").alias("both")).join(strong.select(F.col("given").alias("a"), "need"), "a").where("both >= need")
    p = F.lit(1.0) - F.pow(F.lit(1.0) - F.least("q", F.lit(1.0)), F.col("k"))
    terms = [(F.col("c") * F.pow(F.col("w").cast("double"), F.lit(n)) * p).cast("decimal(30,15)").alias(name) for n, name in ((1, "chance"), (2, "spread"))]
    for own, other in ("ab", "ba"):
        each = shared.join(strong.select(F.col("given").alias(other), "q"), other).join(classes.select(F.col("given").alias(own), "k", "w", "c"), own)
        tested = each.select("a", "b", "both", *terms).groupBy("a", "b", "both").agg(*(F.sum(n).cast("double").alias(n) for n in ("chance", "spread")))
        shared = tested.where(F.col("both").cast("double") >= F.col("chance") + LEARN_SIGMAS * F.sqrt("spread")).select("a", "b", "both")
    ends = F.array_sort(F.array(*(F.struct(F.length(c).alias("n"), F.col(c).alias("x")) for c in "ab")))
    return shared.select(ends[0]["x"].alias("short"), ends[1]["x"].alias("full")).mapInArrow(_unexplained, "short string, full string")


def learned(names: DataFrame) -> dict[str, set[str]]:
    """{pet form: {full forms}} of the general list and of learned_pairs(), to look at: all of them come to the driver.
    attach() joins them instead."""
    pets = {k: set(v) for k, v in FULL_FORMS.items()}
    for r in learned_pairs(names).collect():
        pets.setdefault(r["short"], set()).add(r["full"])
    return pets


def _givens(batches):
    """id, name -> id, short: what may be a person's given name in a spelling."""
    for b in batches:
        out = [(i, g) for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not read(name)[0] for g in {g for g, _ in read(name)[2] if len(g) > 1}]
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["id", "short"])


def with_pets(names: DataFrame) -> DataFrame:
    """names with pets: the learned forms of the given names of each spelling, null without any."""
    forms = cut(learned_pairs(names).groupBy("short").agg(F.array_sort(F.collect_set("full")).alias("full")))
    if forms.isEmpty():
        return names.withColumn("pets", F.lit(None).cast(PETS))
    found = salted_join(names.select("id", "name").mapInArrow(_givens, "id long, short string"), forms, ["short"], "inner", "id")
    return cut(names.join(found.groupBy("id").agg(F.collect_list(F.struct("short", "full")).alias("pets")), "id", "left"))


def _pets(*own):
    """The general list with the learned forms of some spellings."""
    learnt = {f["short"]: FULL_FORMS.get(f["short"], set()) | set(f["full"]) for pets in own for f in pets or ()}
    return ChainMap(learnt, FULL_FORMS) if learnt else FULL_FORMS


def _emit(batches):
    """id, project, name, pets -> key, and twice-shifted id with bit 1 where it offers and bit 2 where it seeks."""
    for b in batches:
        found: list[int] = []
        refs: list[int] = []
        for i, project, name, own in zip(*(b.column(k).to_pylist() for k in range(4))):
            offers, seeks = keys(name, _pets(own))
            scope = xxhash.xxh3_64_intdigest(project)
            for k in offers | seeks:
                found.append(xxhash.xxh3_64_intdigest(k, scope) >> 1)
                refs.append(i << 2 | (k in offers) | (k in seeks) << 1)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(refs, pa.int64())], names=["key", "ref"])


def _meet(batches):
    """Sorted (key, ref) -> (a, b, ways): spellings a < b under one key, with bit 1 where a may be b's candidate and
    bit 2 where b may be a's. A step gives half a million pairs at most."""

    def within(keys, refs):
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        left = np.repeat(starts + sizes, sizes) - np.arange(len(keys)) - 1
        ids, role = refs >> 2, refs & 3
        at, lag = np.flatnonzero(left > 0), 1
        while at.size:
            for k in range(0, len(at), 500_000):
                i = at[k : k + 500_000]
                j = i + lag
                ways = (role[i] & 1) & (role[j] >> 1) | ((role[j] & 1) & (role[i] >> 1)) << 1
                i, j, ways = i[ways > 0], j[ways > 0], ways[ways > 0]
                if i.size:
                    yield pa.record_batch([pa.array(ids[i]), pa.array(ids[j]), pa.array(ways.astype(np.int32))], names=["a", "b", "ways"])
            lag += 1
            at = at[left[at] >= lag]

    keys, refs = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        keys, refs = np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([refs, b.column(1).to_numpy()])
        if keys.size and (last := int(np.searchsorted(keys, keys[-1]))):
            yield from within(keys[:last], refs[:last])
            keys, refs = keys[last:], refs[last:]
    if keys.size:
        yield from within(keys, refs)


def _score(batches):
    schema = pa.schema([("project", pa.string()), ("name", pa.string()), ("candidate", pa.string()), ("n", pa.int64()), ("cost", pa.float64())])
    for b in batches:
        out = []
        for project, x, nx, px, y, ny, py, ways in zip(*(b.column(i).to_pylist() for i in range(8))):
            pets = _pets(px, py)
            for way, seen, ns, meant, nm in ((1, y, ny, x, nx), (2, x, nx, y, ny)):
                # a candidate ranks above what is attached to it: full forms first, then by frequency, then by code point
                if ways & way and (not read(seen)[1] or nm > ns or nm == ns and meant < seen):
                    cost = channel_cost(seen, meant, pets)
                    if cost <= MAX_COST:
                        out.append((project, seen, meant, nm, cost))
        if out:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def attach(names: DataFrame) -> DataFrame:
    """(project, name, n, canonical): each spelling with the root it belongs to."""
    names = with_pets(cut(names.select(F.monotonically_increasing_id().alias("id"), "project", "name", F.col("n").cast("long").alias("n"))))
    keyed = names.select("id", "project", "name", "pets").mapInArrow(_emit, "key long, ref long")
    met = keyed.repartition("key").sortWithinPartitions("key", "ref").mapInArrow(_meet, "a long, b long, ways int")
    met = met.groupBy("a", "b").agg(F.bit_or("ways").alias("ways"))
    left = names.select(F.col("id").alias("a"), "project", F.col("name").alias("x"), F.col("n").alias("nx"), F.col("pets").alias("px"))
    right = names.select(F.col("id").alias("b"), F.col("name").alias("y"), F.col("n").alias("ny"), F.col("pets").alias("py"))
    pairs = met.join(left, "a").join(right, "b").select("project", "x", "nx", "px", "y", "ny", "py", "ways")
    weight = (F.col("n") * F.exp(-F.col("cost"))).cast("decimal(38,18)")  # exact sums, whatever their order
    scored = cut(pairs.mapInArrow(_score, "project string, name string, candidate string, n long, cost double").withColumn("w", weight).drop("cost"))
    return names.join(roots(scored), ["project", "name"], "left").select("project", "name", "n", F.coalesce("root", "name").alias("canonical"))


def roots(scored: DataFrame) -> DataFrame:
    """(project, name, root) of the spellings with candidates; scored: (project, name, candidate, n, w). The weights of
    candidates with one root are summed, and the root with the most takes the spelling if it holds MIN_SHARE of all.
    Every candidate ranks above its spelling, so the rounds settle, from the top down, on one result."""
    by = [F.col("w"), F.col("c"), F.transform(F.split("to", ""), lambda c: -F.ascii(c))]
    state = cut(scored.select("project", "name").distinct().withColumn("root", F.col("name")))
    while True:
        above = state.select("project", F.col("name").alias("candidate"), F.col("root").alias("to"))
        each = scored.join(above, ["project", "candidate"], "left").groupBy("project", "name", F.coalesce("to", "candidate").alias("to")).agg(F.sum("w").alias("w"), F.max("n").alias("c"))
        best = each.groupBy("project", "name").agg(F.max_by("to", F.struct(*by)).alias("to"), F.max("w").alias("top"), F.sum("w").alias("all"))
        held = F.when(F.col("top").cast("double") >= MIN_SHARE * F.col("all").cast("double"), F.col("to")).otherwise(F.col("name"))
        after = cut(best.select("project", "name", held.alias("next")).join(state, ["project", "name"]))
        state = after.select("project", "name", F.col("next").alias("root"))
        if after.where("next <> root").isEmpty():
            return state


def pairs(groups: DataFrame) -> DataFrame:
    """(project, name_a, name_b) with name_a < name_b by code point: every pair of one person's or organisation's
    spellings. A group holds the spellings of one name, not rows."""
    a = groups.select("project", "canonical", F.col("name").alias("name_a"))
    b = groups.select("project", "canonical", F.col("name").alias("name_b"))
    return a.join(b, ["project", "canonical"]).where("name_a < name_b").select("project", "name_a", "name_b")
