"""Personal data: candidate spans scored by gradient-boosted trees (DataFrame functions only).

Base spans (e-mail, IPv4, card and phone patterns with their checks) are
always reported.  High-recall generators then propose further spans, which
may overlap each other, in the text that the base spans leave: addresses in
written-out forms, and all runs of up to seven neighbouring digit groups with
7 to 19 digits in total.

Each span gets a kind and integer features of its format and context.  The
marks by which the base patterns decide, an e-mail's @ sign and a phone
number's plus, are no features.  So the trees, boosted on the counts of all
feature cells of all documents with the base spans as positives and the
generators' other proposals as negatives, learn what a kind looks like apart
from its mark, and a number without plus, an address with "(at)", or one of
two numbers in a row, for which the base patterns have no match, is found by
its likeness to spans that they prove elsewhere.  Per kind the margins are
calibrated on the other half of the documents (isotonic regression); the
threshold is the lowest margin down to which the share of base spans is
``PRECISION`` with confidence (lower end of the Wilson interval).  An accepted
span stays if no accepted span that overlaps it has a larger margin.

A feature that says nothing about a kind is 0 for it, so there are fewer than
60,000 cells for each half at any size of the corpus; their counts are all that comes to
the driver, and the trees go back into the plan as CASE expressions.

Work on one text with n spans is of the order of its length plus n to the
power 1.5: running sums are built in blocks of sqrt(n) (``running``), and
substrings are taken from pieces of the text (``Pieces``), never from its start.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)

#: The base patterns, in forms that never backtrack over long runs: possessive
#: repeats, and starts only where a run of the first class starts (or where
#: the last match ended).  They find the same leftmost matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generator of addresses: the at sign may be spaced or written out, dots may be too, and the domain may have one part only.
_AT = r"\x20?+(?:@|[(\[{]\x20?+at\x20?+[)\]}])\x20?+"
_DOT = r"(?:\.|\x20?+[(\[{]\x20?+dot\x20?+[)\]}]\x20?+)"
ADDRESS = rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+"
#: Generator of numbers: what may stand between two digit groups, groups at most, digits at least and at most.
BETWEEN = r"^[\x20().\-/]{1,2}$"
GROUPS, PART = 7, (7, 19)
PRECISION, SIGMAS = 0.9, 1.64
TREES, RATE = 24, 0.3
FEATURES = {"kind": 4, "digits": 21, "groups": 8, "dots": 4, "paren": 2, "sep": 5, "luhn": 2, "octets": 2, "before": 4, "after": 4, "hint": 2}
#: Code points of left context that a span keeps, and of the pieces that a text is cut into.
LEFT, PIECE = 24, 4096
#: Stands in for the characters of base spans where the generators look; it is part of no word or number.
MASK = "\ue000"


# --- arrays in one pass ------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``op`` over an array of ints.

    ``aggregate`` copies what it has gathered at every step, so that is done
    in blocks of about sqrt(n), and the blocks' totals are added afterwards.
    """
    none = F.array().cast("array<int>")

    def prefix(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x).otherwise(op(F.get(a, F.size(a) - 1), x)))))

    def joined(blocks: Column) -> Column:
        def add(totals: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.get(totals, i - 1), x)))))

        return let(prefix(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1))), add)

    def blocked(xs: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda i: prefix(F.slice(xs, i * width + 1, width)))
        return F.when(F.size(xs) == 0, none).otherwise(let(blocks, joined))

    return let(values, blocked)


def _sum(a: Column, b: Column) -> Column:
    return a + b


class Pieces:
    """A text in pieces of ``PIECE`` code points, so that a substring costs no walk from the text's start."""

    @staticmethod
    def of(text: Column) -> Column:
        return F.when(F.char_length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)))

    @staticmethod
    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """Code points from ``start`` up to ``end``."""
        first = F.floor(start / PIECE).cast("int")
        held = F.floor((end - 1) / PIECE).cast("int") - first + 1
        return F.when(end <= start, F.lit("")).otherwise(F.substring(F.array_join(F.slice(pieces, first + 1, held), ""), start - first * PIECE + 1, end - start))


# --- checks and features -----------------------------------------------------


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string has a sum divisible by ten when every second digit from the right is doubled."""
    n = F.char_length(digits)
    place = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.substring(digits, n - i + 1, F.lit(1)).cast("int").alias("d")))
    worth = F.transform(place, lambda p: F.when(p["i"] % 2 == 1, p["d"]).when(p["d"] > 4, 2 * p["d"] - 9).otherwise(2 * p["d"]))
    return F.when(n > 0, F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(F.lit(False))


_OCTET = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_QUAD = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _holds(rank: int, v: Column) -> Column:
    if rank == EMAIL:
        return F.lit(True)
    if rank == IP:
        return v.rlike(_QUAD)
    n = F.char_length(_digits(v))
    if rank == CARD:
        # the digits are checked only where their number is right
        return F.when(n.between(14, 19), _luhn(_digits(v))).otherwise(F.lit(False))
    return n.between(10, 15)


def _checker(rank: int):
    return lambda s: _holds(rank, s["v"])


def _of(rank: int):
    return lambda s: s["rank"] == rank


def _class(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike(r"^[0-9]$"), 2).otherwise(3)


def _described(start: Column, end: Column, kind: Column, v: Column, left: Column, after: Column) -> Column:
    """A candidate: its place, its kind and the kind's features; ``v`` is the span without a phone number's plus."""

    def features(d: Column) -> Column:
        n = F.char_length(d)
        seps = F.regexp_replace(v, "[0-9]", "")
        sep = F.when(seps == "", 0).when(seps.rlike(r"^\x20+$"), 1).when(seps.rlike("^-+$"), 2).when(seps.rlike(r"^\.+$"), 3).otherwise(4)
        number = kind >= CARD
        return F.struct(
            start.alias("start"),
            end.alias("end"),
            kind.alias("kind"),
            F.when(number, F.least(n, F.lit(20))).otherwise(0).alias("digits"),
            F.when(number, F.least(F.size(F.split(v, "[^0-9]+")), F.lit(7))).otherwise(0).alias("groups"),
            F.when(kind == EMAIL, F.least(F.regexp_count(F.regexp_replace(v, rf"(?i)^[A-Za-z0-9._%+-]++{_AT}", ""), F.lit(rf"(?i){_DOT}")), F.lit(3))).otherwise(0).alias("dots"),
            F.when(number, v.contains("(").cast("int")).otherwise(0).alias("paren"),
            F.when(number, sep).otherwise(0).alias("sep"),
            F.when((kind == CARD) & n.between(14, 19), _luhn(d).cast("int")).otherwise(0).alias("luhn"),
            F.when(kind == IP, v.rlike(_QUAD).cast("int")).otherwise(0).alias("octets"),
            _class(F.substring(F.regexp_replace(left, r"\+$", ""), -1, 1)).alias("before"),
            _class(after).alias("after"),
            left.rlike(r"(?i)(?:mail|tel|phone|call|fax|card|visa|account|ip|host|contact)[^\p{L}]{0,4}$").cast("int").alias("hint"),
        )

    return let(_digits(v), features)


# --- spans -------------------------------------------------------------------

_FOUND = "struct<start:int,end:int,v:string,left:string,after:string>"


def _located(text: Column, pattern: str, needs: Column) -> Column:
    """All matches with their places in code points, the text on their left (back to the match before) and the character after them."""

    def places(b: Column) -> Column:
        def spans(ends: Column) -> Column:
            return F.transform(
                b["found"],
                lambda v, i: F.struct(
                    (F.get(ends, i) - F.char_length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("v"), F.substring(F.get(b["gaps"], i), -LEFT, LEFT).alias("left"), F.substring(F.get(b["gaps"], i + 1), 1, 1).alias("after")
                ),
            )

        return let(running(F.zip_with(b["found"], F.slice(b["gaps"], F.lit(1), F.size(b["found"])), lambda v, g: F.char_length(g) + F.char_length(v)), _sum), spans)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(needs, let(both, places)).otherwise(F.array().cast(f"array<{_FOUND}>"))


_GROUP = "struct<start:int,end:int,v:string,left:string,after:string,joined:boolean>"


def _groups(text: Column) -> Column:
    """The digit groups of a text with the text on their left; ``joined``: nothing but ``BETWEEN`` stands between it and the group before."""

    def places(tokens: Column) -> Column:
        def groups(ends: Column) -> Column:
            def group(t: Column, i: Column) -> Column:
                left = F.coalesce(F.get(tokens, i - 1), F.lit(""))
                return F.struct(
                    (F.get(ends, i) - F.char_length(t)).alias("start"), F.get(ends, i).alias("end"), t.alias("v"), F.substring(left, -LEFT, LEFT).alias("left"),
                    F.substring(F.coalesce(F.get(tokens, i + 1), F.lit("")), 1, 1).alias("after"), ((i > 1) & left.rlike(BETWEEN)).alias("joined"),
                )

            return F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike("^[0-9]"), group(t, i))), lambda g: g.isNotNull())

        return let(running(F.transform(tokens, lambda t: F.char_length(t)), _sum), groups)

    # a text without seven digits near each other has no candidate
    near = text.rlike(r"[0-9](?:[\x20().\-/]{0,2}[0-9]){6}")
    return F.when(near, let(F.regexp_extract_all(text, F.lit("[0-9]++|[^0-9]++"), F.lit(0)), places)).otherwise(F.array().cast(f"array<{_GROUP}>"))


def _numbers(groups: Column) -> Column:
    """All candidates made of consecutive digit groups of a run: with ``PART`` digits, or a whole run."""
    low, high = PART

    def one(s: Column, k: Column, first: Column, following: Column) -> Column:
        text = F.array_join(F.transform(s, lambda x, j: F.when(j == 0, x["v"]).otherwise(F.concat(x["left"], x["v"]))), "")
        digits = F.aggregate(s, F.lit(0), lambda a, x: a + F.char_length(x["v"]))
        end = F.element_at(s, -1)
        whole = first & (k < GROUPS) & (k == following)
        return F.struct(F.element_at(s, 1)["start"].alias("start"), end["end"].alias("end"), text.alias("v"), F.element_at(s, 1)["left"].alias("left"), end["after"].alias("after"), digits.alias("digits"), whole.alias("whole"))

    def from_group(all_groups: Column, g: Column, i: Column) -> Column:
        def within(w: Column) -> Column:
            spans = F.transform(F.sequence(F.lit(1), F.size(w)), lambda k: let(F.slice(w, F.lit(1), k), lambda s: one(s, k, ~g["joined"], F.size(w))))
            return F.filter(spans, lambda c: (c["digits"] >= low) & ((c["digits"] <= high) | c["whole"]))

        def run(s: Column) -> Column:
            """The groups up to the first that isn't joined to the one before."""
            breaks = F.filter(F.transform(s, lambda x, j: F.when((j > 0) & ~x["joined"], j)), lambda j: j.isNotNull())
            return F.slice(s, F.lit(1), F.coalesce(F.get(breaks, 0), F.size(s)))

        return let(let(F.slice(all_groups, i + 1, F.lit(GROUPS)), run), within)

    def kinds(c: Column) -> Column:
        quad = c["v"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
        return F.when(quad, F.array(F.lit(IP))).when(c["digits"] < 14, F.array(F.lit(PHONE))).when(c["digits"] < 16, F.array(F.lit(CARD), F.lit(PHONE))).otherwise(F.array(F.lit(CARD)))

    spans = let(groups, lambda gs: F.flatten(F.transform(gs, lambda g, i: from_group(gs, g, i))))
    return F.flatten(F.transform(spans, lambda c: F.transform(kinds(c), lambda kind: _raw(c, kind, c["v"], F.lit(False)))))


_SPAN = "struct<start:int,rank:int,end:int>"


def _union(spans: Column) -> Column:
    """Sorted spans that overlap made one, which keeps the rank of the first."""

    def joined(b: Column) -> Column:
        opening = F.filter(F.transform(b["spans"], lambda s, i: F.when((i == 0) | (s["start"] >= F.get(b["ends"], i - 1)), i)), lambda i: i.isNotNull())

        def union(firsts: Column) -> Column:
            last = F.size(b["ends"])
            return F.transform(firsts, lambda at, k: F.struct(F.get(b["spans"], at)["start"].alias("start"), F.get(b["spans"], at)["rank"].alias("rank"), F.get(b["ends"], F.coalesce(F.get(firsts, k + 1), last) - 1).alias("end")))

        return let(opening, union)

    return let(spans, lambda found: let(F.struct(found.alias("spans"), running(F.transform(found, lambda s: s["end"]), F.greatest).alias("ends")), joined))


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with ``mark`` of each span in the place of the (sorted) spans; those that overlap are made one."""

    def build(b: Column) -> Column:
        before = lambda s, i: F.concat(Pieces.cut(b["pieces"], F.when(i == 0, 0).otherwise(F.get(b["spans"], i - 1)["end"]), s["start"]), mark(s))
        return F.concat(F.array_join(F.transform(b["spans"], before), ""), Pieces.cut(b["pieces"], F.get(b["spans"], F.size(b["spans"]) - 1)["end"], b["n"]))

    def held(found: Column) -> Column:
        return F.struct(Pieces.of(text).alias("pieces"), _union(found).alias("spans"), F.char_length(text).alias("n"))

    return let(spans, lambda found: F.when(F.size(found) == 0, text).otherwise(let(held(found), build)))


def _masked(text: Column, spans: Column) -> Column:
    return replaced(text, spans, lambda s: F.repeat(F.lit(MASK), s["end"] - s["start"]))


def _spans_of(rank: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))


def _proven(rank: int):
    """A base span as a candidate; a phone number's plus is left out, and with it the marks."""
    skip = 1 if rank == PHONE else 0
    return lambda s: _raw(s, F.lit(rank), F.substring(s["v"], F.lit(1 + skip), F.char_length(s["v"])), F.lit(True))


def _raw(s: Column, kind: Column, v: Column, positive: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), v.alias("v"), s["left"].alias("left"), s["after"].alias("after"), positive.alias("positive"))


def analyse(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``base`` (all base spans as sorted (start, rank of the kind, end)) and ``candidates``: the base spans (positive) and what the generators propose in the rest of the text, with kind and features."""
    t, rest, bare = (F.col(f"__pii_{c}") for c in ("text", "rest", "bare"))
    needs = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": t.contains("+")}
    held = {k: F.col(f"__pii_{k}") for k in (*KINDS, "proven", "addresses", "groups")}
    base, candidates = "__pii_base", "__pii_candidates"

    # One step for each column that the next one reads more than once: the optimiser doesn't merge such steps, and plans stay small.
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__pii_text"))
    out = out.select("*", *[F.filter(_located(t, BASE[k], needs[k]), _checker(i)).alias(f"__pii_{k}") for i, k in enumerate(KINDS)])
    out = out.select(
        "*",
        F.array_sort(F.concat(*[F.transform(held[k], _spans_of(i)) for i, k in enumerate(KINDS)])).alias(base),
        F.concat(*[F.transform(held[k], _proven(i)) for i, k in enumerate(KINDS)]).alias("__pii_proven"),
    )
    out = out.select("*", _masked(t, F.col(base)).alias("__pii_rest"))
    out = out.select("*", _located(rest, ADDRESS, rest.contains("@") | rest.rlike(r"(?i)[(\[{]\x20?at\x20?[)\]}]")).alias("__pii_addresses"))
    # numbers are looked for outside of addresses, so the two never overlap
    places = F.transform(held["addresses"], _spans_of(EMAIL))
    out = out.select("*", _masked(rest, places).alias("__pii_bare"))
    out = out.select("*", _groups(bare).alias("__pii_groups"))
    written_out = F.transform(held["addresses"], lambda s: _raw(s, F.lit(EMAIL), s["v"], F.lit(False)))
    every = F.concat(held["proven"], written_out, _numbers(held["groups"]))
    out = out.select(*keep, base, F.transform(every, lambda c: F.struct(_described(c["start"], c["end"], c["kind"], c["v"], c["left"], c["after"]).alias("c"), c["positive"].alias("positive"))).alias(candidates))
    return out.select(*keep, F.col(base).alias("base"), F.col(candidates).alias("candidates"))


# --- boosting on cells -------------------------------------------------------


class BoostedTrees:
    """Logistic boosting of depth-two trees over weighted feature cells."""

    def __init__(self, cells: np.ndarray, positive: np.ndarray, total: np.ndarray):
        self.trees: list[tuple] = []
        self.base = math.log((positive.sum() + 1) / (total.sum() - positive.sum() + 1))
        margin = np.full(len(cells), self.base)
        for _ in range(TREES if len(cells) else 0):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = positive - total * p, total * p * (1 - p)
            tree = self._grow(cells, gradient, weight, np.ones(len(cells), bool), 2)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)
            margin += self._apply(tree, cells)

    def _grow(self, cells, gradient, weight, here, depth):
        leaf = lambda m: RATE * float(np.clip(gradient[m].sum() / (weight[m].sum() + 1.0), -8, 8))
        if depth == 0:
            return leaf(here)
        gain = lambda m: gradient[m].sum() ** 2 / (weight[m].sum() + 1.0)
        best, cut = gain(here) + 1e-3, None
        for f in range(cells.shape[1]):
            for value in np.unique(cells[here, f])[:-1]:
                low = here & (cells[:, f] <= value)
                g = gain(low) + gain(here & ~low)
                if g > best:
                    best, cut = g, (f, int(value))
        if cut is None:
            return leaf(here)
        low = here & (cells[:, cut[0]] <= cut[1])
        return (*cut, self._grow(cells, gradient, weight, low, depth - 1), self._grow(cells, gradient, weight, here & ~low, depth - 1))

    def _apply(self, tree, cells):
        if not isinstance(tree, tuple):
            return np.full(len(cells), tree)
        f, value, low, high = tree
        return np.where(cells[:, f] <= value, self._apply(low, cells), self._apply(high, cells))

    def margins(self, cells: np.ndarray) -> np.ndarray:
        return self.base + sum((self._apply(t, cells) for t in self.trees), np.zeros(len(cells)))

    def column(self, c: Column) -> Column:
        names = list(FEATURES)

        def case(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, value, low, high = tree
            return F.when(c[names[f]] <= value, case(low)).otherwise(case(high))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + case(tree)
        return out


def assured(share_of: float, positive: float) -> float:
    """Lower end of the Wilson interval of a share: ``positive`` of ``share_of`` cases."""
    p, z = positive / share_of, SIGMAS**2 / share_of
    return (p + z / 2 - math.sqrt(z * p * (1 - p) + z * z / 4)) / (1 + z)


class PiiModel:
    def __init__(self, cells: list[tuple], precision: float = PRECISION):
        """cells: (features..., half, candidates, positive ones)."""
        width = len(FEATURES)
        data = np.array(cells, dtype=float).reshape(-1, width + 3)
        learn, held = (data[data[:, width] == h] for h in (0, 1))
        self.trees = BoostedTrees(learn[:, :width], learn[:, width + 2], learn[:, width + 1])
        self.thresholds = [math.inf] * len(KINDS)
        margin = self.trees.margins(held[:, :width])
        for kind in range(len(KINDS)):
            rows = np.flatnonzero(held[:, 0] == kind)
            rows = rows[np.argsort(-margin[rows], kind="stable")]
            blocks: list[list[float]] = []  # pooled adjacent violators: [candidates, positives, lowest margin]
            for i in rows:
                blocks.append([held[i, width + 1], held[i, width + 2], margin[i]])
                while len(blocks) > 1 and (blocks[-1][2] == blocks[-2][2] or blocks[-1][1] * blocks[-2][0] >= blocks[-2][1] * blocks[-1][0]):
                    n, p, low = blocks.pop()
                    blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + p, low]
            n = p = 0.0
            for size, positive, low in blocks:  # shares fall
                if positive < precision * size:
                    break
                n, p = n + size, p + positive
                if assured(n, p) >= precision:
                    self.thresholds[kind] = float(low)

    def accepted(self, c: Column) -> Column:
        at = F.lit(None).cast("double")
        for kind, threshold in enumerate(self.thresholds):
            if math.isfinite(threshold):
                at = F.when(c["kind"] == kind, F.lit(threshold - 1e-9)).otherwise(at)
        return F.coalesce(self.trees.column(c) >= at, F.lit(False)) if any(map(math.isfinite, self.thresholds)) else F.lit(False)


def fit(analysed: DataFrame) -> PiiModel:
    """Count the feature cells of all candidates of all documents and boost on them. A kind's cells are bounded by its own features, all kinds' by 60,000 for each half."""
    rows = analysed.select("doc_id", F.explode("candidates").alias("x")).select((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2).cast("int").alias("half"), "x.c.*", "x.positive")
    cells = rows.groupBy(*FEATURES, "half").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("int")).alias("p"))
    return PiiModel(sorted(tuple(r) for r in cells.collect()))


#: Accepted numbers that may overlap one of them, on either side of it in the order of their starts: they have at most
#: 19 digits and 7 groups, so they start in 31 places around it, and no place starts more than 14.
NEIGHBOURS = 31 * 14


def all_spans(model: PiiModel) -> Column:
    """Base spans and the accepted candidates as sorted (start, rank of the kind, end). An accepted one stays if no accepted one that overlaps it has a larger margin (of equal ones: is longer, starts before it, or is of a kind before its)."""
    extra = F.filter("candidates", lambda x: ~x["positive"] & (x["c"]["digits"] <= PART[1]) & model.accepted(x["c"]))

    def weighed(x: Column) -> Column:
        c = x["c"]
        order = F.struct(model.trees.column(c).alias("margin"), (c["end"] - c["start"]).alias("n"), (-c["start"]).alias("first"), (-c["kind"]).alias("kind"))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("rank"), order.alias("order"))

    def chosen(all_: Column) -> Column:
        def stays(x: Column, i: Column) -> Column:
            near = F.slice(all_, F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * NEIGHBOURS + 1))
            beaten = F.exists(near, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & (y["order"] > x["order"]))
            return F.when(~beaten, F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))

        return F.filter(F.transform(all_, stays), lambda s: s.isNotNull())

    def with_added(found: Column) -> Column:
        return F.when(F.size(found) == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", let(F.array_sort(F.transform(found, weighed)), chosen))))

    return let(extra, with_added)


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by [EMAIL], [IP], [CARD] or [PHONE]; spans that overlap become one, named after the first."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return replaced(text, spans, lambda s: F.element_at(marks, s["rank"] + 1))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, personal data in ``text`` replaced.

    The rows are written once with their spans, and the model is fitted on
    what was written, so texts are analysed once.  Null and empty texts stay
    as they are, long ones are searched whole; repeated rows stay, whatever
    their other columns are called; rows without an id are redacted like all
    others; an empty table gives no rows.
    """
    names = list(docs.columns)
    row = "__pii_row"
    # columns may be of any name and of types that a struct holds and Parquet stores
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col("text").alias("__pii_source"), F.col("doc_id"))
    found = written(analyse(packed, "__pii_source", ("doc_id", row)), "pii-spans")
    model = fit(found)
    marked = found.select(row, all_spans(model).alias("__pii_spans"))
    clean = F.when(F.col(row)["text"].isNotNull(), redacted(F.col(row)["text"], F.col("__pii_spans")))
    return marked.select(*[(clean if c == "text" else F.col(row)[c]).alias(c) for c in names])


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; null counts as empty.

    One row per row of the table, repeated rows and rows without an id
    included; texts without personal data have zero counts, the hash of the
    empty string and empty ``spans``.  An empty table gives no rows; columns
    besides doc_id and text are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    analysed = written(analyse(docs), "pii-spans")
    model = fit(analysed)
    counts = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return analysed.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(all_spans(model)).alias("spans"))


QUERIES = {"op5_boosted_pii": op5_boosted_pii}
ORACLES: dict[str, str] = {}
