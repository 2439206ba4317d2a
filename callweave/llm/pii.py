"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans; labelers (pattern checks, gazetteers, context, borders) vote on each; expectation-
maximisation over the counts of vote patterns estimates how reliable the labelers are; a span classifier
is trained on what that gives and decides on the spans that the base patterns don't cover.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .labelled import logistic

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "border")
SHAPES = 4

# The base patterns, written so that no text makes a search go back over what it has read.
# \G lets a match start right after the last one, as a search without the look-behind would.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
# Shapes that the base leaves out and the labelers judge.
_MORE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:[ ]?[\[({{][ ]?(?:at|AT)[ ]?[\])}}][ ]?{_LABEL}(?:(?:\.|[ ]?[\[({{][ ]?(?:dot|DOT)[ ]?[\])}}][ ]?){_LABEL}){{1,5}}|@{_LABEL}(?![A-Za-z0-9.@-]))",
    "ip": r"(?=[0-9A-Fa-f])(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?=[0-9])(?<![0-9A-Za-z.,])(?<![0-9][ -])[0-9]{4}(?:[ -]?[0-9]){9,15}(?![ -]?[0-9])(?![.,]?[0-9A-Za-z])",
    "phone": r"(?=[0-9(])(?<![0-9A-Za-z+.-])(?<![0-9+][ )(.-])(?:00[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
}
# The gazetteers. Top-level domains, card prefixes, calling codes, addresses of no host.
_TLDS = "com|net|org|edu|gov|mil|int|info|biz|io|ai|dev|app|eu|de|fr|es|it|uk|us|ca|nl|be|ch|at|pl|se|no|fi|dk|pt|ru|jp|cn|in|br|mx|au|nz|ie|example|test"
_ISSUERS = "4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14}|62[0-9]{14,17}"
_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[013]|21[1-9]|9[67][0-9]|85[0-9]"
_NO_HOST = r"(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
# Words before a span that speak for its kind, and words that speak against any.
_SPEAKS = {
    "email": "e-?mail|mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|client|login|adresse|direcci[oó]n",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|telefon|t[eé]l[eé]phone|tel[eé]fono|anruf|appel",
}
_AGAINST = r"(?:isbn|issn|version|release|\bv|section|order|serial|invoice|id|ref|chapter|page)[ .:#=-]{0,3}$"

_FOUND = "struct<start:int,end:int,m:string,before:string,after:string>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The base patterns' further conditions."""
    n = F.length(_digits(m))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items of a running fold that are gathered by one growing array; arrays of such parts are put together once.
_RUN = 256


def _running(values: Column, op) -> Column:
    """For each place of an array of integers, op (associative) over all up to it; not for empty arrays. n values cost about n * _RUN + (n / _RUN) ** 2 copies of a number."""
    none = F.array().cast("array<int>")

    def push(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.when(F.size(acc) > 0, op(F.try_element_at(acc, F.lit(-1)), x)).otherwise(x)))

    def folded(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(_RUN))
        parts = F.transform(starts, lambda s: F.aggregate(F.sequence(s, F.least(s + _RUN, F.size(v)) - 1), none, lambda acc, i: push(acc, F.get(v, i))))
        return _let(parts, joined)

    def joined(parts: Column) -> Column:
        totals = F.aggregate(parts, none, lambda acc, part: push(acc, F.element_at(part, -1)))
        return _let(totals, lambda t: F.flatten(F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(F.transform(part, lambda x: op(F.get(t, k - 1), x))))))

    return _let(values, folded)


def _located(matches: Column, pieces: Column) -> Column:
    """Start and end (code points), match and surroundings of each match, from what a split at the matches leaves between them."""

    def item(ends: Column):
        def made(m: Column, i: Column) -> Column:
            end = F.get(ends, i)
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m"), F.substring(F.get(pieces, i), -40, 40).alias("before"), F.substring(F.get(pieces, i + 1), 1, 2).alias("after"))

        return made

    lengths = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
    made = _let(_running(lengths, lambda a, b: a + b), lambda ends: F.transform(matches, item(ends)))
    return F.when(F.size(matches) > 0, made).otherwise(F.array().cast(f"array<{_FOUND}>"))


def _apart(more: Column, base: Column) -> Column:
    """Those of more that overlap none of base, neither of them empty: all are sorted by where they start, and each looks at the
    largest end of base spans up to its place and at the first start of those after it."""

    def kept(spots: Column) -> Column:
        ends = _running(F.transform(spots, lambda s: F.when(s["at"] < 0, s["end"]).otherwise(F.lit(0))), F.greatest)
        starts = F.reverse(_running(F.reverse(F.transform(spots, lambda s: F.when(s["at"] < 0, s["start"]).otherwise(F.lit(2**31 - 1)))), F.least))
        clear = _let(ends, lambda e: _let(starts, lambda b: F.filter(spots, lambda s, i: (s["at"] >= 0) & (F.get(e, i) <= s["start"]) & (F.get(b, i) >= s["end"]))))
        return F.transform(clear, lambda s: F.get(more, s["at"]))

    def spot(c: Column, at: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), at.alias("at"))

    return _let(F.sort_array(F.concat(F.transform(base, lambda c: spot(c, F.lit(-1))), F.transform(more, lambda c, i: spot(c, i)))), kept)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, base: bool, c: Column) -> list[Column]:
    """The labelers' votes (1, -1, 0: none), in the order of LABELERS, and the shape."""
    m, before, after = c["m"], F.lower(c["before"]), c["after"]
    d = _digits(m)
    n = F.length(d)
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(m, r"[ ]?[\[({][ ]?(?:at|AT)[ ]?[\])}][ ]?", "@"), r"[ ]?[\[({][ ]?(?:dot|DOT)[ ]?[\])}][ ]?", ".")
        pattern = _vote(plain.rlike(rf"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:{_LABEL}\.)+[A-Za-z]{{2,24}}$"), ~plain.contains("@") | ~plain.contains("."))
        gazetteer = _vote(F.lower(plain).rlike(rf"\.(?:{_TLDS})$"), ~plain.contains("."))
        shape = F.when(m.contains("@"), F.when(plain.contains("."), 0).otherwise(1)).otherwise(2)
    elif kind == "ip":
        pattern = _vote(valid(kind, m) | m.contains(":"), F.lit(False))
        gazetteer = _vote(F.lit(False), m.rlike(f"^{_NO_HOST}") | m.rlike("^(?:0{1,4}:){7}"))
        shape = F.when(m.contains(":"), 1).otherwise(0)
    elif kind == "card":
        pattern = _vote(n.between(13, 19) & luhn(d), ~luhn(d))
        gazetteer = _vote(d.rlike(f"^(?:{_ISSUERS})$"), F.lit(True))
        shape = F.when(m.rlike("^[0-9]+$"), 0).when(m.rlike("^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}$"), 1).otherwise(2)
    else:
        pattern = _vote(n.between(10, 15), n < 7)
        gazetteer = _vote(d.rlike(f"^(?:00)?(?:{_CODES})") if not base else d.rlike(f"^(?:{_CODES})"), d.rlike("^0+$"))
        shape = F.when(m.startswith("+"), 0).when(m.startswith("00"), 1).when(m.startswith("("), 2).otherwise(3)
    context = _vote(before.rlike(f"(?:{_SPEAKS[kind]})[^\\n]{{0,24}}$"), before.rlike(_AGAINST))
    border = _vote(~before.rlike(r"[\p{L}0-9_/=@.-]$") & ~after.rlike(r"^(?:[\p{L}0-9_/=@]|[.-][\p{L}0-9])"), F.lit(True))
    return [*(v.cast("int").alias(f"v{i}") for i, v in enumerate((pattern, gazetteer, context, border))), shape.cast("int").alias("shape")]


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns as the struct row, with the array found of spans: kind, start, end, base, votes and shape.

    Base spans that fail their conditions are out; other shapes only where they overlap no base span.
    """
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = out.withColumn("digit", F.col("text").rlike("[0-9]"))
    may = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+"), "ip": F.col("digit"), "card": F.col("digit")}
    more = {"email": F.col("text").contains("@") | F.col("text").rlike(r"(?i)[\[({][ ]?at[ ]?[\])}]"), "phone": F.col("digit"), "ip": F.col("digit") & F.col("text").contains(":"), "card": F.col("digit")}

    def holds(kind: str):
        return lambda c: valid(kind, c["m"])

    searches = [(k, True, _BASE[k], may[k]) for k in KINDS] + [(k, False, _MORE[k], more[k]) for k in KINDS]
    none = F.array().cast("array<string>")
    out = out.select("row", "text", *(F.when(when, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}_{b}") for k, b, p, when in searches))
    out = out.select("row", "text", *(f"m_{k}_{b}" for k, b, _, _ in searches), *(F.when(F.size(f"m_{k}_{b}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"p_{k}_{b}") for k, b, p, _ in searches))
    out = out.select("row", *(_located(F.col(f"m_{k}_{b}"), F.col(f"p_{k}_{b}")).alias(f"s_{k}_{b}") for k, b, _, _ in searches))
    out = out.withColumns({f"s_{k}_True": F.filter(f"s_{k}_True", holds(k)) for k in KINDS})

    def judged(k: str, base: bool, spans: Column) -> Column:
        return F.transform(spans, lambda c: F.struct(F.lit(KINDS.index(k)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(base).alias("base"), *_votes(k, base, c)))

    out = out.select("row", F.concat(*(judged(k, True, F.col(f"s_{k}_True")) for k in KINDS)).alias("base"), F.concat(*(judged(k, False, F.col(f"s_{k}_False")) for k in KINDS)).alias("more"))
    apart = F.when((F.size("more") > 0) & (F.size("base") > 0), _apart(F.col("more"), F.col("base"))).otherwise(F.col("more"))
    return out.select("row", F.concat("base", apart).alias("found"))


def reliabilities(votes: Sequence[tuple[int, ...]], kinds: Sequence[int], counts: Sequence[float], rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over patterns of votes seen `counts` times.

    Returns each pattern's posterior, the labelers' chances of voting -1, 0, 1 on false and on true spans
    ([labeler, truth, vote + 1]), and each kind's share of true spans. Labelers are independent given the truth; pseudo-counts
    that hold them better than chance break the symmetry.
    """
    v, k, n = np.array(votes, np.int64).reshape(len(counts), -1), np.array(kinds, np.int64), np.array(counts, float)
    soft = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])
    q = 1 / (1 + np.exp(-v.sum(1).astype(float)))
    for _ in range(rounds):
        chance = np.empty((v.shape[1], 2, 3))
        for j, truth in product(range(v.shape[1]), (0, 1)):
            own = np.bincount(v[:, j] + 1, n * (q if truth else 1 - q), 3) + soft[truth]
            chance[j, truth] = own / own.sum()
        share = (np.bincount(k, n * q, len(KINDS)) + 1) / (np.bincount(k, n, len(KINDS)) + 2)
        z = np.log(share[k] / (1 - share[k])) + sum(np.log(chance[j, 1, v[:, j] + 1] / chance[j, 0, v[:, j] + 1]) for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - q).max(initial=0) < 1e-9
        q = new
        if done:
            break
    return q, chance, share


def _places(kind: int, votes: Sequence[int], shape: int) -> list[int]:
    """The features that a span has: its kind, each labeler's vote, and its kind's shape."""
    return [kind, *(len(KINDS) + 3 * j + v + 1 for j, v in enumerate(votes)), len(KINDS) + 3 * len(votes) + SHAPES * kind + shape]


def span_classifier(patterns: Sequence[tuple]) -> np.ndarray:
    """Weights of the features of `_places`, from rows (kind, votes..., shape, count) whose truth the labelers' votes estimate."""
    kinds, votes, shapes, counts = ([p[0] for p in patterns], [tuple(p[1:-2]) for p in patterns], [p[-2] for p in patterns], [p[-1] for p in patterns])
    size = len(KINDS) + 3 * len(LABELERS) + SHAPES * len(KINDS)
    if not patterns:
        return np.zeros(size)
    q, _, _ = reliabilities(votes, kinds, counts)
    x = np.zeros((len(patterns), size))
    for row, k, v, s in zip(x, kinds, votes, shapes, strict=True):
        row[_places(k, v, s)] = 1
    # Rare patterns count for more than their share, or the base's would drown them.
    n = np.sqrt(np.array(counts, float))
    return logistic(np.concatenate([x, x]), np.repeat([1.0, 0.0], len(x)), np.concatenate([n * q, n * (1 - q)]), ridge=0.1)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, found): all columns of docs as a struct, and the array of spans (start, kind index, end, kind, base), sorted.

    Base spans always stay. A null text counts as empty and has no spans; rows without an id, repeated rows
    and empty tables are like others. Spans are in code points, the end exclusive.

    One pass over the texts writes the candidates; the counts of their patterns (at most kinds x votes x shapes
    rows, whatever the input) train the classifier on the driver; its weights are literals in the second pass. Nothing is
    shuffled but those counts.
    """
    held = written(candidates(docs, text_col), "candidates")
    keys = ["kind", *(f"v{i}" for i in range(len(LABELERS))), "shape"]
    seen = held.select(F.explode("found").alias("c")).select(*(F.col(f"c.{k}").alias(k) for k in keys)).groupBy(*keys).count().collect()
    weights = span_classifier(sorted(map(tuple, seen)))
    literal = F.array(*(F.lit(float(w)) for w in weights))

    def logit(c: Column) -> Column:
        n = len(KINDS)
        places = [c["kind"], *(F.lit(n + 3 * j + 1) + c[f"v{j}"] for j in range(len(LABELERS))), F.lit(n + 3 * len(LABELERS)) + SHAPES * c["kind"] + c["shape"]]
        total = F.lit(0.0)
        for p in places:
            total = total + F.element_at(literal, p + 1)
        return total

    names = F.array(*map(F.lit, KINDS))
    kept = F.filter("found", lambda c: c["base"] | (logit(c) >= 0))
    spans = F.array_sort(F.transform(kept, lambda c: F.struct(c["start"], c["kind"].alias("rank"), c["end"], F.element_at(names, c["kind"] + 1).alias("kind"), c["base"].alias("base"))))
    return held.select("row", spans.alias("found"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 of the listed base spans, and all spans listed."""
    spans = find(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    base = F.filter("found", lambda s: s["base"])

    def of(kind: str):
        return lambda s: s["base"] & (s["kind"] == kind)

    counts = [F.size(F.filter("found", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select(F.col("row.id").alias(id_col), *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


#: Code points of a block of a text; a piece of the text is cut from the blocks that it lies in.
_BLOCK = 1024


def _replaced(text: Column, spans: Column) -> Column:
    """text with each of the sorted spans (one at least) replaced by its kind; those that overlap are one."""

    def groups(tops: Column) -> Column:
        """Where spans begin that no earlier one reaches, each with the largest end before the next of them."""
        starts = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("at"), s["kind"].alias("kind")))
        heads = F.filter(starts, lambda h: (h["at"] == 0) | (F.get(tops, h["at"] - 1) <= h["start"]))
        last = F.size(tops) - 1
        return _let(heads, lambda g: F.transform(g, lambda h, j: F.struct(h["start"].alias("start"), F.get(tops, F.coalesce(F.get(g, j + 1)["at"] - 1, last)).alias("end"), h["kind"].alias("kind"))))

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _BLOCK).cast("int")
        held = F.array_join(F.transform(F.sequence(first, F.floor((end - 1) / _BLOCK).cast("int")), lambda k: F.get(blocks, k)), "")
        return F.when(start < end, F.substring(held, start - first * _BLOCK + 1, end - start)).otherwise(F.lit(""))

    def made(merged: Column, blocks: Column) -> Column:
        before = F.transform(merged, lambda g, j: F.concat(cut(blocks, F.when(j == 0, 0).otherwise(F.get(merged, j - 1)["end"]), g["start"]), F.lit("<"), g["kind"], F.lit(">")))
        return F.concat(F.array_join(before, ""), cut(blocks, F.element_at(merged, -1)["end"], F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    tops = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return _let(_let(tops, groups), lambda merged: _let(blocks, lambda b: made(merged, b)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of a text replaced by its kind in angle brackets; overlapping spans are one, named after the first.

    Null texts stay null; null ids, repeated rows and empty tables are like others; a text may hold any number of spans.
    """
    found = find(docs, text_col)
    text = F.col(f"row.`{text_col}`")
    new = F.when(F.size("found") > 0, _replaced(text, F.col("found"))).otherwise(text)
    return found.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
