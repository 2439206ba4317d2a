"""Automata: patterns and hand-made ones over sequences and paths, Python's regexes in Java, predicates, shared selections."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from callweave.functions.columns import display
from callweave.functions.regexes import java
from callweave.operators import automata, closure, select
from callweave.operators.automata import ANY, Alt, Automaton, One, Seq, Star, automaton, matches
from callweave.operators.paths import paths
from callweave.operators.select import ALL, Label, Name, Predicate, Regex, Where
from callweave.operators.spec import SpecError, pattern, selection
from callweave.sources.facts import build, facts


def graph(spark, names, edges, labels=()):
    rows = [{"kind": "node", "name": n} for n in names] + [{"kind": "edge", "name": a, "target": b} for a, b in edges] + [{"kind": "label", "name": n, "label": k} for n, k in labels]
    return build(facts(spark, rows))


RING = [f"n{i}" for i in range(7)]


@pytest.fixture(scope="module")
def ring(spark):
    """A ring with a chord; n1, n2 and n5 are labelled."""
    return graph(spark, RING, [*zip(RING, RING[1:] + RING[:1], strict=True), ("n2", "n5"), ("n5", "n1")], [(n, "L") for n in ("n1", "n2", "n5")])


@pytest.fixture(params=["determinised", "own states"])
def way(request, monkeypatch):
    if request.param == "own states":
        monkeypatch.setattr(automata, "MOST_MOVES", 0)
    return request.param


def walks(edges, names):
    """All simple paths."""
    out, todo = [], [[n] for n in names]
    while todo:
        path = todo.pop()
        out.append(path)
        todo += [[*path, b] for a, b in edges if a == path[-1] and b not in path]
    return out


def found(g, p, **more):
    return sorted(" ".join(r["path"]) for r in paths(g, p, external_ok=True, **more).collect())


def test_even(spark, ring, way):
    """What no pattern's text says: an even number of labelled nodes."""
    own = Automaton([(0, Label("L"), 1), (1, Label("L"), 0), (0, ~Label("L"), 0), (1, ~Label("L"), 1)], {0}, {0})
    edges = [*zip(RING, RING[1:] + RING[:1], strict=True), ("n2", "n5"), ("n5", "n1")]
    want = sorted(" ".join(p) for p in walks(edges, RING) if sum(n in ("n1", "n2", "n5") for n in p) % 2 == 0)
    assert found(ring, own) == want and len(want) > 10
    several = Automaton([(0, ALL, 7), (0, Name("n3"), 9), (7, Label("L"), 9)], {0}, {9})  # two moves for one node
    assert found(ring, several) == sorted(["n3"] + [f"{a} {b}" for a, b in edges if b in ("n1", "n2", "n5")])


def test_many_places(spark, way):
    names = [f"c{i}" for i in range(70)]
    g = graph(spark, names, zip(names, names[1:], strict=False))
    text = "c0 " + "(c3 | []) " * 65 + "[] c67 ([] | c1 c2 | /nothing/)" + " []*" * 70
    assert found(g, pattern(text)) == [" ".join(names[:k]) for k in (69, 70)]
    assert len(automaton(pattern(text)).moves) > 200


PATTERNS = ["n1 [L]", "(n0 | n1)* n2", "... [!L]", "[L] ... [L]", "[L]* n3 []", "(n0 n1 | [L])*", "/[135]/ /[246]/*", "... n2 ... | n0"]


@pytest.mark.parametrize("text", PATTERNS)
def test_sequences(spark, ring, way, text):
    """Whole sequences, as often as they come, against Python's regexes over one letter a name."""
    rng = random.Random(text)
    pool = [*RING, "elsewhere"]
    rows = [(i, [rng.choice(pool) for _ in range(rng.randrange(6))]) for i in range(80)] + [(90, []), (91, None), (92, ["n1", None]), (93, ["n1", "n1"]), (94, ["n1", "n1"])]
    rows = [*rows, *rows[:3]]
    letters = dict(zip(pool, "abcdefgx", strict=True))
    spelled = {"n0": "a", "n1": "b", "n2": "c", "n3": "d", "[L]": "[bcf]", "[!L]": "[^bcf]", "...": ".*", "[]": ".", "/[135]/": "[bdf]", "/[246]/*": "[ceg]*"}
    plain = re.compile("".join(spelled.get(w, w) for w in re.findall(r"/.*?/\*?|\[.*?\]|\.\.\.|n\d|\S", text)))
    got = matches(ring, spark.createDataFrame(rows, "accepted_id long, names array<string>"), "names", pattern(text)).collect()
    want = [(i, s, None if s is None else False if None in s else bool(plain.fullmatch("".join(letters[x] for x in s)))) for i, s in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("made,empty", [(Seq(), True), (Alt(), True), (Star(One(ALL)), True), (One(ALL), False), (Seq((ANY, ANY)), True), (Alt((One(ALL), Seq())), True), (Automaton([], {0}, {0}), True), (Automaton([], {0}, set()), False)])
def test_empty_sequences(spark, ring, made, empty):
    rows = spark.createDataFrame([([],), (["n1"],)], "s array<string>")
    got = {len(r["s"]): r["accepted"] for r in matches(ring, rows, "s", made).collect()}
    assert got[0] == empty and got[1] == (made not in (Seq(), Alt()) and not (isinstance(made, Automaton)))
    assert matches(ring, rows.where("false"), "s", made).count() == 0
    assert found(ring, Seq()) == found(ring, Automaton([], {0}, {0})) == []  # a path has a node


def test_names_unknown_to_the_graph(spark, ring):
    rows = spark.createDataFrame([(["new", "n1"],), (["new", "new"],)], "s array<string>")
    for p, want in ((Seq((One(Name("new")), One(Label("L")))), [True, False]), (Seq((One(~Label("L")), One(Regex("e")))), [False, True])):
        assert [r["accepted"] for r in sorted(matches(ring, rows, "s", p).collect(), key=lambda r: r["s"][1])] == want


def test_places():
    a, b = One(Name("a")), One(Name("b"))
    own = automaton(Seq((Star(a), Alt((b, Seq((a, ANY)))))))
    assert own.start == {0} and own.final == {2, 3, 4}
    assert {(p, q) for p, _, q in own.moves} == {(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (3, 4), (4, 4)}


def test_shared_selections(spark, ring, monkeypatch):
    asked, plain = [], closure.reach
    monkeypatch.setattr(closure, "reach", lambda *a, **b: (asked.append(a), plain(*a, **b))[1])
    assert len(found(ring, pattern("[L:all_callees] [L:all_callees] | [L:all_callees:callers]"))) > 5 and len(asked) == 1
    asked.clear()
    selection("[L:all_callees] [!L,[L:all_callees]] [L:all_callees]").ids(ring).collect()
    assert len(asked) == 1


def test_predicates(spark, ring):
    odd = Predicate(lambda name: int(name[1:]) % 2 == 1)
    same = Where(lambda c: F.substring(c, 2, 9).cast("int") % 2 == 1)
    names = lambda s: sorted(r["n"] for r in ring.nodes.join(s.ids(ring), "id").select(display().alias("n")).collect())
    assert names(odd) == names(same) == ["n1", "n3", "n5"] and names(~odd & Label("L")) == ["n2"]
    assert found(ring, Seq((One(odd), One(odd)))) == ["n5 n1"]
    asked = spark.sparkContext.accumulator(0)
    twins = build(facts(spark, [{"kind": "node", "name": f"s{i}", "username": "twin()"} for i in range(30)]))

    def counted(name):
        asked.add(1)
        return name == "twin()"

    assert Predicate(counted).ids(twins).count() == 30 and asked.value == 1  # once for a name, not for each node


ATOMS = "a b é Ж ß _ 1 ٣ \\d \\w \\s \\D \\W \\S . [a-é] [^ab] [\\w-] [^\\W\\d] \\b \\B ^ $ \\A \\Z (b) (?:ab|Ж) (?=a) (?!b) (?<=a) (?<!é) (?i:É) (?i:[a-k]) x{,1} [\\]\\[] \\. (?s:.) (?>a*) \\x41 (?m:^a) (?m:b$) (?P<n>a|é)".split()
TEXTS = ["", "a", "é", "É", "ab", "aé1", "a b", "Ж_x", "straße", "A\n", "\na", "a\nb\n", "٣4", "_a1", "x", "ab\u2028c", "K", "\u212a", "ſ", "e\u0301", "𝒜b", "a]b[", "aa", "éé", "bab"]


def some_patterns(seed, n):
    rng = random.Random(seed)
    while n:
        parts = [(x, "" if re.match(r"\\[bBAZ]|[$^]|\(\?(=|!|<)", x) else rng.choice(["", "", "", "*", "+", "?", "{1,2}", "{,2}", "*?", "+?", "{2}", "?+"])) for x in rng.choices(ATOMS, k=rng.randint(1, 4))]
        text = ("(?i)" if rng.random() < 0.15 else "") + "".join(map("".join, parts)) + ("(?P=n)" if any("P<n>" in x for x, _ in parts) and rng.random() < 0.5 else "")
        try:
            re.compile(text)
        except re.error:
            continue
        n -= 1
        yield text


def test_regexes(spark):
    held, refused = [], 0
    for text in some_patterns(3, 200):
        try:
            held.append((text, java(text)))
        except ValueError:
            refused += 1
    assert refused < 20
    names = spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1)
    for part in itertools.batched(held, 50):
        for r in names.select("t", *(F.col("t").rlike(j).alias(str(i)) for i, (_, j) in enumerate(part))).collect():
            assert [bool(re.search(p, r["t"])) for p, _ in part] == list(r[1:])


@pytest.mark.parametrize("text", ["(", "a{2,1}", "(?P<n>a)(?P<n>b)", "(a)?(?(1)b|c)", "(a)*\\1", "(?i)(a)\\1", "[z-a]", "\\8"])
def test_refused_regexes(text):
    with pytest.raises(ValueError):
        Regex(text)
    with pytest.raises(SpecError):
        selection("/" + text.replace("\\", "\\\\") + "/")


def test_interning_keeps_selections_apart():
    assert select.Name("a") == select.Name("a") != select.Label("a") and len({selection("[L:callees]"), selection("[L:callees]"), selection("[L:callers]")}) == 2
