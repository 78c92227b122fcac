"""Personal data in texts, in DataFrame functions only: fixed patterns with checks, and candidates judged by boosted trees.

Base spans come from one pattern and one check per kind. Beyond them, high-recall generators propose spans that may overlap (every run of
digit groups that holds 7 to 15 digits, obfuscated addresses, cards with other separators); gradient-boosted trees over features of format and context, fitted on
a bounded sample and on texts with planted personal data and look-alikes, and turned into SQL expressions, give each a calibrated probability, and those above
the threshold are added.

Places of matches: ``split`` gives the text between matches and ``regexp_extract_all`` the matches, so the lengths add up to offsets.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import free_name

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive quantifiers and the look-behind only keep the search linear: a match starts at the start of a run of the first
#: class or right behind the last match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: The generators of further candidates, by the kind they propose.
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++){1,6}+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]{1,3}+(?:\[\.\]|,|\x20?\.\x20?)[0-9]{1,3}+(?:\[\.\]|,|\x20?\.\x20?)[0-9]{1,3}+(?:\[\.\]|,|\x20?\.\x20?)[0-9]{1,3}+",
    "card": r"(?:\G|(?<![0-9]))[0-9]{4}+[\x20._/-]{0,2}+[0-9]{4,6}+[\x20._/-]{0,2}+[0-9]{4,5}+(?:[\x20._/-]{0,2}+[0-9]{1,7}+)?+",
    # whole runs of digit groups; :func:`grouped` proposes their parts. Digits and separators are disjoint, so the possessive quantifiers lose nothing.
    "phone": r"[+(]{0,2}+[0-9]++(?:[\x20()./-]{1,4}+[0-9]++)*+",
}

#: A text without these cannot match.
HINTS = {"email": r"[@\[(]", "ip": r"[0-9][., \[]", "card": r"[0-9][0-9 -][0-9 -]*[0-9]", "phone": r"[0-9]"}

FEATURES = ("starts_zero", "first_group", "last_group", "date", "other_cue", "digits", "length", "groups", "plus", "paren", "luhn", "dots", "alnum_before", "alnum_after", "longest", "octets", "at", "marker", "cue", "run_before", "run_after", "is_email", "is_ip", "is_card")


def digits_of(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(m: str) -> str:
    d = f"reverse({digits_of(m)})"
    return f"(aggregate(transform(split({d}, ''), (c, i) -> case when c = '' then 0 when i % 2 = 0 then int(c) when int(c) < 5 then 2 * int(c) else 2 * int(c) - 9 end), 0, (a, x) -> a + x) % 10 = 0)"


def octets(m: str) -> str:
    return f"forall(split(regexp_replace({m}, '[^0-9]+', '.'), '[.]'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', right(ltrim('0', p), 3))) <= 255)"


CHECKS = {
    "email": "true",
    "ip": octets("x.m"),
    "card": f"(length({digits_of('x.m')}) between 16 and 19 and {luhn('x.m')})",
    "phone": f"(length({digits_of('x.m')}) between 8 and 15)",
}


BLOCK = 64  # matches that are handled together, so that no step compares each match with all others or copies all before it


def in_blocks(array: str) -> str:
    """``array`` cut into arrays of ``BLOCK`` elements, none of them empty."""
    return f"filter(transform(sequence(0, size({array}) div {BLOCK}), i -> slice({array}, i * {BLOCK} + 1, {BLOCK})), x -> size(x) > 0)"


def places(text: str, pattern: str, hint: str) -> Column:
    """array<struct<s, e, m>>: start and end (exclusive) in code points, and the text, of the leftmost non-overlapping matches. Offsets add up inside a block,
    and blocks add up, so a text with very many matches costs little more than they do."""
    t = F.when(F.col(text).rlike(hint), F.col(text)).otherwise("")
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    gaps = F.split(t, pattern, -1)
    empty = F.expr("cast(array() as array<struct<s: int, e: int, m: string>>)")

    def add(acc, x):
        start = acc["at"] + F.char_length(x["g"])
        end = start + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    def add_block(acc, block):
        one = F.aggregate(block, F.struct(acc["at"].alias("at"), empty.alias("out")), add)
        # the fold of a block is bound once, then taken apart
        return F.transform(F.array(one), lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))[0]

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(g.alias("g"), m.alias("m")))
    numbers = F.sequence(F.lit(0), F.floor(F.size(found) / BLOCK).cast("int"))
    blocks = F.transform(F.array(pairs), lambda all_: F.transform(numbers, lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK))))[0]
    nested = F.expr("cast(array() as array<array<struct<s: int, e: int, m: string>>>)")
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), nested.alias("out")), add_block, lambda acc: F.flatten(acc["out"]))


def grouped(x: str, least: int = 7, most: int = 15) -> str:
    """array<struct<s, e, m>>: every part of the run ``x`` that starts and ends with a whole digit group and holds ``least`` to ``most`` digits,
    with a plus or bracket right before its first group. A group starts at most ``most`` parts. Runs are gone through in blocks of groups, each with as many
    groups more as a part can have."""
    none = "cast(array() as array<struct<s: int, e: int, d: int, t: int>>)"
    group = "regexp_extract(p, '[0-9]+$', 0)"
    entry = f"named_struct('s', a.at + char_length(p) - char_length(regexp_extract(p, '[+(]*[0-9]+$', 0)), 'e', a.at + char_length(p), 'd', char_length({group}), 't', a.t + char_length({group}))"
    add = f"(a, p) -> named_struct('at', a.at + char_length(p), 't', a.t + char_length({group}), 'out', concat(a.out, array({entry})))"
    fits = f"h -> h.t - g.t + g.d between {least} and {most}"
    made = f"h -> named_struct('s', z.o + g.s, 'e', z.o + h.e, 'm', substring(z.m, g.s + 1, h.e - g.s))"
    parts = f"flatten(transform(slice(a.out, 1, {BLOCK}), (g, i) -> transform(filter(slice(a.out, i + 1, {most}), {fits}), {made})))"
    block = f"aggregate(z.p, named_struct('at', 0, 't', 0, 'out', {none}), {add}, a -> {parts})"
    # a block: its groups with those after it, their text joined, and where that begins
    cut = f"""aggregate(sequence(0, size(all_) div {BLOCK}), named_struct('o', {x}.s, 'z', cast(array() as array<struct<o: int, m: string, p: array<string>>>)),
      (c, i) -> named_struct('o', c.o + char_length(array_join(slice(all_, i * {BLOCK} + 1, {BLOCK}), '')),
        'z', concat(c.z, array(named_struct('o', c.o, 'm', array_join(slice(all_, i * {BLOCK} + 1, {BLOCK + most}), ''), 'p', slice(all_, i * {BLOCK} + 1, {BLOCK + most}))))), c -> c.z)"""
    return f"flatten(flatten(transform(array(regexp_extract_all({x}.m, '[^0-9]*[0-9]+', 0)), all_ -> transform({cut}, z -> {block}))))"


def proposed(docs: DataFrame, name: str, kind: str, text: str = "text") -> DataFrame:
    """Adds the column ``name``: the spans that the kind's generator proposes; those of phones may overlap one another."""
    out = docs.withColumn(name, places(text, GENERATORS[kind], HINTS[kind]))
    return out.withColumn(name, F.expr(f"flatten(transform(filter({name}, x -> char_length(x.m) >= 7), x -> {grouped('x')}))")) if kind == "phone" else out


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds an array column ``base_<kind>`` for each kind."""
    out = docs
    for k in KINDS:
        out = out.withColumn(f"base_{k}", places(text, PATTERNS[k], HINTS[k] if k != "email" else "@"))
    return out.select(*docs.columns, *[F.expr(f"filter(base_{k}, x -> {CHECKS[k]})").alias(f"base_{k}") for k in KINDS])


def feature_columns(kind: str, m: str, before: str, after: str) -> dict[str, str]:
    d = digits_of(m)
    return {
        "starts_zero": f"int(startswith({d}, '0'))",
        "first_group": f"length(regexp_extract({m}, '[0-9]+', 0))",
        "last_group": f"length(regexp_extract({m}, '([0-9]+)[^0-9]*$', 1))",
        "date": f"int(regexp_like({m}, '^(19|20)[0-9][0-9][-/. ]|[-/. ](19|20)[0-9][0-9]$'))",
        "other_cue": f"int(regexp_like(lower({before}), '(order|isbn|ref|version|total|invoice|serial|lot|page|item|score|year|date|num|no)[^a-z]*$'))",
        "digits": f"length({d})",
        "length": f"char_length({m})",
        "groups": f"size(filter(split({m}, '[^0-9]+'), g -> g <> ''))",
        "plus": f"int(startswith({m}, '+') or endswith({before}, '+'))",
        "paren": f"int(contains({m}, '('))",
        "luhn": f"int(length({d}) > 0 and {luhn(m)})",
        "dots": f"length({m}) - length(replace({m}, '.', ''))",
        "alnum_before": f"int(regexp_like({before}, '[A-Za-z0-9.@_-]$'))",
        "alnum_after": f"int(regexp_like({after}, '^[A-Za-z0-9@_-]'))",
        "longest": f"array_max(transform(split({m}, '[^0-9]+'), g -> length(g)))",
        "octets": f"int({octets(m)})",
        "at": f"int(contains({m}, '@'))",
        "marker": f"int(regexp_like({m}, '[\\\\[(](at|dot)[\\\\])]'))",
        "cue": f"int(regexp_like(lower({before}), '(tel|phone|call|fax|mobile|ring|mail|write|contact|card|visa|pay|ip|addr|host|server)[^a-z]*$'))",
        "run_before": f"int(regexp_like({before}, '[0-9][ ()./-]{{1,4}}[+(]*$'))",
        "run_after": f"int(regexp_like({after}, '^[ ()./-]{{1,4}}[0-9]'))",
        "is_email": str(int(kind == "email")),
        "is_ip": str(int(kind == "ip")),
        "is_card": str(int(kind == "card")),
    }


def candidates(based: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``cand``: array of proposed spans (kind, s, e, features ..., base: whether it lies on a base span of its kind, of a phone exactly;
    part: it is a mere part of a base phone, tail: one that ends with it), which may overlap one another.

    A block of candidates is held against the base spans near it, and their context is read from the block's own stretch of text."""
    every = "concat(" + ", ".join(f"transform(base_{k}, b -> named_struct('k', '{k}', 's', b.s, 'e', b.e))" for k in KINDS) + ")"
    out, parts = based.withColumn("base_all", F.expr(every)), []
    for k in KINDS:
        out = proposed(out, f"gen_{k}", k, text)
        f = feature_columns(k, "x.m", "substring(z.t, greatest(x.s - z.o - 15, 1), least(x.s - z.o, 16))", "substring(z.t, x.e - z.o + 1, 5)")
        named = ", ".join(f"'{n}', double({e})" for n, e in f.items())
        over = f"exists(z.b, b -> b.k = '{k}' and b.s < x.e and x.s < b.e)"
        same, tail = ("exists(z.b, b -> b.k = 'phone' and b.s = x.s and b.e = x.e)", "exists(z.b, b -> b.k = 'phone' and b.s < x.s and b.e = x.e)") if k == "phone" else (over, "false")
        one = f"named_struct('kind', '{k}', 's', x.s, 'e', x.e, {named}, 'base', {same}, 'part', {over} and not {same}, 'tail', {tail}, 'taken', exists(z.b, b -> b.s < x.e and x.s < b.e))"
        low, high = "array_min(transform(c, x -> x.s))", "array_max(transform(c, x -> x.e))"
        spans = f"transform({in_blocks(f'gen_{k}')}, c -> named_struct('c', c, 'lo', {low}, 'hi', {high}))"
        near = "filter(base_all, b -> b.e > y.lo and b.s < y.hi)"
        z = f"named_struct('c', y.c, 'b', {near}, 'o', greatest(y.lo - 16, 0), 't', substring({text}, greatest(y.lo - 16, 0) + 1, y.hi - greatest(y.lo - 16, 0) + 6))"
        parts.append(f"flatten(transform(transform({spans}, y -> {z}), z -> transform(z.c, x -> {one})))")
    return out.select(*based.columns, F.expr(f"concat({', '.join(parts)})").alias("cand"))


@dataclass
class Trees:
    """Boosted regression trees: nested (feature, threshold, left, right) or a leaf value; Platt's slope and offset; threshold on the probability."""

    trees: list
    start: float
    slope: float
    offset: float
    threshold: float

    def sql(self, x: str) -> str:
        def one(t) -> str:
            return f"{t!r}D" if isinstance(t, float) else f"CASE WHEN {x}.{FEATURES[t[0]]} <= {t[1]!r}D THEN {one(t[2])} ELSE {one(t[3])} END"

        total = " + ".join([f"{self.start!r}D", *map(one, self.trees)])
        return f"1D / (1D + exp(-({self.slope!r}D * ({total}) + {self.offset!r}D)))"


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float):
    """A tree on gradients g and curvatures h of the log loss."""
    gs, hs = g[rows].sum(), h[rows].sum()
    leaf = float(rate * gs / (hs + 1))
    if depth == 0 or len(rows) < 10:
        return leaf
    best = (1e-6, None, None)
    for j in range(x.shape[1]):
        v = x[rows, j]
        for c in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12))):
            left = v <= c
            a, b = g[rows][left].sum(), h[rows][left].sum()
            if 0 < left.sum() < len(rows):
                gain = a * a / (b + 1) + (gs - a) ** 2 / (hs - b + 1) - gs * gs / (hs + 1)
                if gain > best[0]:
                    best = (gain, j, float(c))
    if best[1] is None:
        return leaf
    left = x[rows, best[1]] <= best[2]
    return (best[1], best[2], grow(x, g, h, rows[left], depth - 1, rate), grow(x, g, h, rows[~left], depth - 1, rate))


def predict(t, x: np.ndarray) -> np.ndarray:
    if isinstance(t, float):
        return np.full(len(x), t)
    return np.where(x[:, t[0]] <= t[1], predict(t[2], x), predict(t[3], x))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 4, rate: float = 0.3, precision: float = 0.95) -> Trees | None:
    """Boosted trees, calibrated by Platt scaling on every third row, with the least probability from 0.5 on that has the asked precision there.
    None if a class is missing."""
    held = np.arange(len(y)) % 3 == 0
    if len(y) < 30 or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None
    tx, ty = x[~held], y[~held].astype(float)
    start = float(np.log((ty.mean() + 1e-3) / (1 - ty.mean() + 1e-3)))
    score, trees = np.full(len(ty), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        t = grow(tx, ty - p, p * (1 - p), np.arange(len(ty)), depth, rate)
        trees.append(t)
        score += predict(t, tx)
    raw = start + sum(predict(t, x[held]) for t in trees)
    hy, slope, offset = y[held].astype(float), 1.0, 0.0
    for _ in range(300):
        err = 1 / (1 + np.exp(-(slope * raw + offset))) - hy
        slope, offset = max(0.05, slope - 0.05 * float((err * raw).mean())), offset - 0.1 * float(err.mean())
    p = 1 / (1 + np.exp(-(slope * raw + offset)))
    good = [c for c in np.arange(0.5, 0.991, 0.01) if (p >= c).any() and hy[p >= c].mean() >= precision]
    return Trees(trees, start, slope, offset, float(good[0]) if good else 0.99)


#: Forms in which personal data and look-alikes are planted into training texts: d is a digit, z one that is not 0, L a digit that makes Luhn's sum fit.
PLANTED = {
    "phone": (
        "(zdd) ddd-dddd zdd-ddd-dddd zdd.ddd.dddd zdd_ddd_dddd 0zdddddddd 0z_dd_dd_dd_dd 0zd_ddddddd 0zd/dddddddd 00zdddddddddd 00zd_dd_dddd_dddd 1-800-ddd-dddd "
        "zd_ddd_dd_dd 0zddd-dddddd 00zd_(0)zdd_dddddd 0zdd_ddd_dd_dd"
    ).split(),
    "email": ["w@w.com", "w.w@w.org", "w[at]w.com", "w_[at]_w_[dot]_net", "w(at)w(dot)org", "w_@_w.com", "w_(at)_w.de"],
    "ip": ["10.zd.zd.d", "192.168.d.zd", "zd[.]zd[.]d[.]zd", "1zd_._zd_._d_._zd"],
    "card": ["4ddd.dddd.dddd.dddL", "4ddd/dddd/dddd/dddL", "5ddd__dddd__dddd__dddL", "4ddd_dddd_dddd_dddL", "37dd.dddddd.ddddL"],
}
CUES = {"phone": ["call", "tel", "phone:", "fax", "mobile", "ring me at", "tel."], "email": ["mail", "write to", "contact"], "ip": ["host", "server", "ip"], "card": ["card", "visa", "pay with"]}
DECOYS = (
    "20dd-0z-1d_1d:dd 1d/0z/20dd 978-z-dd-dddddd-d zddddddddd zdd,ddd,ddd 10.0.1dddd z.d.d.d.d dd.dddd_1d.dddd 19dd-19dd_20dd-20dd zdd-zdd_zdd-zdd dd_dd_dd_dd_dd_dd 1ddd_dddd_dddd_dddd "
    "zddddddddddddd zdd.ddd.ddd.ddd zddd_zddd_zddd 20dd0zdd1ddddd zd.zd_zd.zd_zd.zd zddd/zddd/zdd"
).split()
OTHER_CUES = ["order", "isbn", "ref", "version", "total", "invoice", "serial", "lot", "page", "item", "score", "year", "no."]


def filled(form: str, rng: np.random.Generator) -> str:
    """A form with digits and words filled in; its underscores become blanks."""
    words = ("anna", "jo.smith", "info", "k-lee", "support", "mail2", "north", "example", "acme", "river-side")
    letters = [str(rng.integers(10)) if c == "d" else str(rng.integers(1, 10)) if c == "z" else words[rng.integers(len(words))] if c == "w" and form[0] == "w" else " " if c == "_" else c for c in _marks(form)]
    text = "".join(letters)
    if "L" in text:
        digits = [int(c) for c in text if c.isdigit()][::-1]
        total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits))
        text = text.replace("L", str(-total % 10))
    return text


def _marks(form: str) -> list[str]:
    """The letters of a form; in addresses only a w that stands alone is one to fill, and the d of a marker is none."""
    if form[0] != "w":
        return list(form)
    out = []
    for piece in form.replace("w", "\0w\0").split("\0"):
        out.append("w" if piece == "w" else piece.replace("_", " "))
    return out


def planted_texts(carriers: list[str], rows: int, seed: int) -> list[tuple[str, str, int, int]]:
    """(text, kind, start, end) of short texts, each with one piece of personal data in one of the forms, or with a look-alike (kind "none"), between two
    stretches of real text, with or without a word before it that gives it away."""
    rng, out = np.random.default_rng(seed), []
    carriers = carriers or ["some plain words", ""]
    kinds = [*PLANTED, "none"]
    for _ in range(rows):
        kind = kinds[rng.choice(len(kinds), p=[0.35, 0.1, 0.05, 0.1, 0.4])]
        if kind == "none":
            value, cues = filled(DECOYS[rng.integers(len(DECOYS))], rng), OTHER_CUES
        else:
            value, cues = filled(PLANTED[kind][rng.integers(len(PLANTED[kind]))], rng), CUES[kind]
        cue = f"{cues[rng.integers(len(cues))]} " if rng.random() < 0.75 else ""
        left, right = carriers[rng.integers(len(carriers))], carriers[rng.integers(len(carriers))]
        text = f"{left} {cue}"
        out.append((f"{text}{value}{('.', ',', ' ', ' and')[rng.integers(4)]} {right}", kind, len(text), len(text) + len(value)))
    return out


def sampled(docs: DataFrame, text: str, id_col: str, rows: int, most_bytes: int) -> DataFrame:
    """At most ``rows`` documents of at most ``most_bytes`` bytes, the first by a hash of id and text among those below a bound that fits their number, so that few go on to be sorted. The
    same rows give the same sample, in the same order, however they are dealt."""
    short = docs.where(F.octet_length(text) <= most_bytes)
    share = 0.9 * rows / max(short.count(), 1)
    drawn = F.xxhash64(id_col, text)
    return short.where(F.pmod(drawn, F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30))).select(id_col, text).orderBy(drawn, id_col, text).limit(rows)


def examples(texts: DataFrame, text: str, most: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Features of at most ``most`` candidates, whether each lies on a base span, and the rows: the first by a hash of text and place, in that order."""
    columns = [c for c in texts.columns if c != text]
    found = candidates(base_spans(texts, text), text).select(*columns, F.xxhash64(*columns, text).alias("_own"), F.explode("cand").alias("c")).select(*columns, "_own", "c.*")
    shown = [*columns, "kind", "s", "e", "base", "part", *FEATURES]
    rows = found.orderBy(F.xxhash64("_own", "kind", "s", "e"), "_own", *shown).select(*shown).limit(most).collect()
    return np.array([[r[f] or 0.0 for f in FEATURES] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([bool(r["base"]) for r in rows]), rows


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sample_rows: int = 2000, sample_bytes: int = 10_000, sample_candidates: int = 8000, planted_rows: int = 2000, seed: int = 5) -> Trees | None:
    """Fit on two bounded sets of texts: ``sample_rows`` documents of at most ``sample_bytes`` bytes (``sample_candidates`` candidates of them at most), where base
    spans are personal data and other candidates are not; and ``planted_rows`` short texts made of stretches of those documents with personal data in the forms
    people use or hide them in, and with look-alikes, whose places are known. There a candidate that is the planted span is positive; one that is only a part of
    it, or lies on a look-alike, is negative."""
    spark = docs.sparkSession
    some = sampled(docs, text, id_col, sample_rows, sample_bytes).select(F.col(id_col).alias("own"), F.col(text).alias("t"))
    x, y, rows = examples(some, "t", sample_candidates)
    keep = np.array([not r["part"] for r in rows], bool)
    carriers = [r["c"] for r in some.select(F.xxhash64("own", "t").alias("h"), F.substring("t", 1, 60).alias("c")).where("c <> ''").orderBy("h", "c").collect()]
    px, py = planted_examples(spark, carriers, planted_rows, seed)
    return fit(np.vstack([x[keep], px]), np.concatenate([y[keep], py]))


def as_table(spark, rows: list[tuple[str, str, int, int]]) -> DataFrame:
    """The bounded planted texts as a table (t, own, from_, to_), handed over as one JSON text so that no Python worker takes part."""
    named = json.dumps([dict(zip(("t", "own", "from_", "to_"), r, strict=True)) for r in rows])
    kind = "array<struct<t: string, own: string, from_: int, to_: int>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(named), kind)).alias("r")).select("r.*").repartition(8)


def planted_examples(spark, carriers: list[str], rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    made = as_table(spark, planted_texts(carriers, rows, seed))
    x, _, found = examples(made, "t", 30 * rows)
    # what lies off the planted span is part of a carrier and is not known to be anything
    on = np.array([r["s"] < r["to_"] and r["from_"] < r["e"] for r in found], bool)
    y = np.array([r["own"] == r["kind"] and r["s"] == r["from_"] and r["e"] == r["to_"] for r in found], bool)
    return x[on], y[on]


def measured(model: Trees | None, texts: DataFrame) -> dict[str, tuple[float, float, int]]:
    """Per kind, on planted texts (t, own, from_, to_): recall, precision of the spans that lie on planted ones, and how many were planted. A span counts as right if it has the
    planted kind and covers the planted place."""
    found = personal_data(texts, model, "t").collect()
    out = {}
    for i, k in enumerate(KINDS):
        spans = [(r, x) for r in found for x in r["spans"] if x["k"] == i and x["s"] < r["to_"] and r["from_"] < x["e"]]
        right = {(r["t"]) for r, x in spans if r["own"] == k and x["s"] <= r["from_"] and x["e"] >= r["to_"]}
        planted = sum(r["own"] == k for r in found)
        out[k] = (len(right) / max(planted, 1), sum(r["own"] == k for r, _ in spans) / max(len(spans), 1), planted)
    return out


def personal_data(docs: DataFrame, model: Trees | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``base`` and ``spans``: array<struct<k, s, e>> with k the kind's number in KINDS, sorted by kind, start and end.

    ``spans`` holds all of ``base`` and those candidates off every base span whose probability reaches the model's threshold; of
    candidates that overlap, the most probable stays (of equals the first kind and start, then the longest); one that is dropped drops no other. Null and empty texts have no spans; repeated rows get equal ones. Offsets are in code
    points, ends exclusive. Columns named base, spans, cand, base_* or gen_* are replaced.
    """
    names = [c for c in docs.columns if c not in ("base", "spans", "cand") and not c.startswith(("base_", "gen_"))]
    helper = free_name(docs, "_text")
    docs = docs.select(*names).withColumn(helper, F.coalesce(F.col(text_col), F.lit("")))
    based = base_spans(docs, helper)
    flat = "array_sort(concat(" + ", ".join(f"transform(base_{k}, x -> struct({i} as k, x.s as s, x.e as e))" for i, k in enumerate(KINDS)) + "))"
    if model is None:
        return based.select(*names, F.expr(flat).alias("base"), F.expr(flat).alias("spans"))
    number = "array_position(array('email', 'ip', 'card', 'phone'), x.kind) - 1"
    free = candidates(based, helper).select(*names, F.expr(flat).alias("base"), F.expr("filter(cand, x -> not x.taken)").alias("cand"))
    judged = free.withColumn("cand", F.expr(f"filter(transform(cand, x -> struct({model.sql('x')} as p, int({number}) as k, x.s as s, x.e as e)), x -> x.p >= {model.threshold!r}D)"))
    ranked = "array_sort(transform(cand, x -> struct(-x.p as o, x.k as k, x.s as s, -x.e as f, x.e as e)))"
    best = judged.withColumn("cand", F.expr(f"aggregate({ranked}, cast(array() as array<struct<o: double, k: int, s: int, f: int, e: int>>), (a, x) -> if(exists(a, y -> y.s < x.e and x.s < y.e), a, concat(a, array(x))))"))
    return best.select(*names, "base", F.expr("array_sort(concat(base, transform(cand, x -> struct(x.k as k, x.s as s, x.e as e))))").alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.expr(f"transform({spans}, x -> concat(array('email', 'ip', 'card', 'phone')[x.k], ':', x.s, ':', x.e))"), ",")


def digest(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The columns of the query: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    found = personal_data(docs.select("doc_id", "text"), model)
    return found.select("doc_id", *[F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redacted(docs: DataFrame, model: Trees | None, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; of overlapping spans the first one's kind stands for all."""
    found = personal_data(docs, model, text_col)
    merged = F.expr("aggregate(array_sort(transform(spans, x -> struct(x.s as s, x.e as e, x.k as k))), cast(array() as array<struct<s: int, e: int, k: int>>), (a, x) -> case when size(a) > 0 and a[size(a) - 1].e > x.s then concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].s as s, greatest(a[size(a) - 1].e, x.e) as e, a[size(a) - 1].k as k))) else concat(a, array(x)) end)")
    text = f"aggregate(_m, struct(0 as at, '' as t), (a, x) -> struct(x.e as at, concat(a.t, substring({text_col}, a.at + 1, x.s - a.at), '[', array('email', 'ip', 'card', 'phone')[x.k], ']') as t), a -> concat(a.t, substring({text_col}, a.at + 1)))"
    text = text.replace("_m,", f"{(helper := free_name(found, '_m'))},", 1)
    return found.withColumn(helper, merged).withColumn(text_col, F.expr(text)).select(*[c for c in found.columns if c not in ("base", "spans")])
