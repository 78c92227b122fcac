"""URL verdicts: rules by host and path, and where none fits, logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import map_batches, small_batches

CELLS = 1 << 15
GRAMS = (3, 4, 5)

#: Names of unwanted and of ordinary hosts, written down from general knowledge of both kinds; none is taken from a table that is judged.
UNWANTED = """royalcasino casinobonus luckyslots megajackpot onlinepoker pokerroom sportsbetting betnow freespins roulette777 bingocash winbigprize lottowinner
prizeclaim giftcardwin iphonewinner pillstore buypills viagraonline cheapmeds pharmacydeals weightlosspills adserver adclick banneradserve popunderads trackclick
clicktracker pixeltrack adtracker affiliateclicks spamlinks linkfarm seospam backlinkfarm adultcams xxxvideos hotsexchat adultdating sexshop pornhdtube nudegirls
vegascasino casinoking casinoclub livecasino goldencasino bestbetting betonline sportbets luckybet freebetting pokerstars247 pokernight bingobonus jackpotcity
slotmachine freeslots winmoney winnow cashprize bigprize discountpills dietpills pillsnow cheapviagra cheapcialis genericmeds freeporn pornmovies sexcams
sexvideos adultvideos adulttoys nudecams xxxmovies hotgirls datingadult adsnetwork adsrotator adsclick freeads bannerads clickads trackingads clicktrack trackpixel
spammail spamtraffic trafficfarm clickfarm linkspam seolinks freebonus bonuscash freecash cheapwatches cheapbags freeiphone hackedgames crackedgames freekeygen
freecoins cryptodoubler quickloan paydaycash fakewatches replicabags crackedsoftware keygendownload hackedaccounts malwaredrop phishinglogin verifyaccountnow""".split()
ORDINARY = """library university museum weather history science garden cooking school college hospital citycouncil newspaper dailynews localnews radio television theatre
orchestra concert festival travel railway airport timetable mapservice geography biology chemistry physics mathematics engineering astronomy medicine research journal
archive encyclopedia dictionary grammar translation literature poetry novel bookshop publisher recipes bakery restaurant coffee vegetables farming forestry wildlife
birdwatching hiking cycling football athletics swimming chess photography painting drawing architecture furniture carpentry knitting sewing music guitar piano
opensource software developer database network hardware electronics community charity foundation parliament ministry embassy consulate insurance bank accounting
notary lawyer courthouse police firebrigade kindergarten familydoctor dentist veterinary optician hairdresser florist bicycle carrepair plumber""".split()


def labelled(unwanted: list[str] = UNWANTED, ordinary: list[str] = ORDINARY) -> list[tuple[str, int]]:
    """(host and path, 1: block): each name under four hosts and paths, so that neither subdomain, top level nor path tells the kind."""
    forms = ("{}.com/en/{}", "www.{}.org/de/page{}", "{}.net/index?id={}", "blog.{}.info/fr/{}.html")
    return [(form.format(name, 17 * k + 5), label) for label, names in ((1, unwanted), (0, ordinary)) for k, name in enumerate(names) for form in forms]


#: What the default classifier learns from.
LABELLED = labelled()


def held_out_accuracy(rows: list[tuple[str, int]] = LABELLED, folds: int = 5, threshold: float = 0.6) -> dict[str, float]:
    """Share of right verdicts on hosts that the classifier did not learn from, for unwanted and ordinary ones: all URLs of a name are in one fold."""
    name = lambda u: max(u.partition("/")[0].split("."), key=len)
    fold = [xxhash.xxh3_64_intdigest(name(u)) % folds for u, _ in rows]
    right = {0: [], 1: []}
    for k in range(folds):
        model = fit([(*split_url(u), y) for (u, y), f in zip(rows, fold, strict=True) if f != k])
        for (u, y), f in zip(rows, fold, strict=True):
            if f == k:
                right[y].append((score(*model, *split_url(u)) >= threshold) == bool(y))
    return {"block": float(np.mean(right[1])), "allow": float(np.mean(right[0]))}


def split_url(u: str) -> tuple[str, str]:
    host, _, rest = u.partition("/")
    return host, "/" + rest.partition("?")[0]


#: Rules (host, path, verdict) of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def cells(host: str, path: str) -> np.ndarray:
    """Distinct cells of the n-grams of the marked host and of the marked path, each kind hashed apart."""
    out = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            out.update(xxhash.xxh3_64_intdigest(kind + text[i : i + n]) & (CELLS - 1) for i in range(len(text) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def fit(rows: Iterable[tuple[str, str, int]], epochs: int = 60, rate: float = 0.5, ridge: float = 1e-4, most_rows: int = 20_000) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled (host, path, label) rows, ``most_rows`` at most. Without rows everything is allowed."""
    rows = list(rows)[:most_rows]
    w, bias = np.zeros(CELLS), -1.0 if not rows else 0.0
    x = [cells(h, p) for h, p, _ in rows]
    rng = np.random.default_rng(3)
    for epoch in range(epochs if rows else 0):
        for i in rng.permutation(len(rows)):
            scale = 1 / np.sqrt(len(x[i]) or 1)
            g = 1 / (1 + np.exp(-np.clip(w[x[i]].sum() * scale + bias, -30, 30))) - rows[i][2]
            step = rate / (1 + 0.05 * epoch)
            w[x[i]] -= step * (g * scale + ridge * w[x[i]])
            bias -= step * g * 0.1
    return w, float(bias)


def score(w: np.ndarray, bias: float, host: str, path: str) -> float:
    c = cells(host, path)
    return float(1 / (1 + np.exp(-np.clip(w[c].sum() / np.sqrt(len(c) or 1) + bias, -30, 30))))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url_col: str) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there up to "?", "#" or the end.
    Null, or without "://": both empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(coalesce({url_col}, ''), instr(coalesce({url_col}, ''), '://') + 3)")).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; null when none does. Rules of one length: the first listed."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: list[tuple[str, int]] = LABELLED, threshold: float = 0.6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, ``score`` (of the classifier, null where a rule decides).

    A null or malformed url has empty host and path; no rule fits it, the classifier judges its empty n-grams. An empty table of labels allows what no rule
    blocks. Repeated rows get equal verdicts.
    Only the url column is read. The broadcast is the weights, of fixed size. No shuffle.
    """
    small_batches(pages.sparkSession, 10_000)
    split = [(*split_url(u), y) for u, y in labelled]
    sent = pages.sparkSession.sparkContext.broadcast(fit(split))
    host, path = host_and_path(url_col)
    chosen = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    ruled = chosen.select("id", "host", "path", name.alias("rule"), verdict.alias("by_rule"))

    def make():
        w, bias = sent.value
        return lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.array([None if r else score(w, bias, h, p) for h, p, r in zip(*(b.column(c).to_pylist() for c in ("host", "path", "by_rule")), strict=True)], pa.float64())], [*b.schema.names, "score"])

    kind = chosen.schema["id"].dataType.simpleString()
    out = map_batches(ruled, f"id {kind}, host string, path string, rule string, by_rule string, score double", make)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
