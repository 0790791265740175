"""Texts cut off by field limits or mid-transfer.

Length evidence: the lengths of each source (of the text and of its trimmed body, in characters
and in bytes) are taken as log-normal and right-censored: a part of the texts longer than a
limit was stored cut to exactly that limit.  Location, spread and the censored part of every
limit of a source are fitted jointly by maximum likelihood (EM on the length histogram).
Candidate limits are all lengths that occur far more often than their surroundings and mostly
with unfinished endings.  A text of a limit's length gets the posterior probability that it was
censored there.  Where such a cut falls on a blank, trimming leaves one character less; these
lengths are fitted along with their limits.

Ending evidence: a text's ending is one of :data:`KINDS`, told with word statistics learned from
the corpus itself, in one pass over all words:

* how often the word is the last of a finished sentence (words such as *the* or *with* never
  are: a text that ends in one is unfinished);
* how often it stands where a clause's predicate stands, and whether single unfinished lines
  avoid it, as headings do (an unfinished line with a predicate is a cut sentence, one without
  is a heading or list entry);
* which words exist at all (a last word that starts a far more frequent one was cut inside;
  last words of texts, which may be cut themselves, are no evidence that a word exists).

Combination: a latent-class model.  A text was cut at a limit (its censoring posterior), cut
elsewhere (the rate of its source) or not at all; a limit also falls between two sentences now
and then, which leaves a whole text.  Each class has its own probabilities of the kinds of
ending; they, the rates and the part of limits between sentences are fitted by EM over all
documents, whose counts per (rate bin, posterior bin, kind) are a table of bounded size.  How
often a whole sentence ends in an ellipsis or in dots is known from the sentences inside of
texts.  No labelled rows are used.

A text that ends in sentence punctuation, a bracketed note, a tag, a symbol or an attribution
is whole by definition, wherever its length lies.  Everything else is decided by the log odds of
the two cut classes against the whole one.  All counts are weighed against each other, so a document is judged alike
whatever the size of the corpus.

Defined cases: null and empty texts are not truncated; ties and repeated rows are judged
alike; null sources share one length model; an empty table gives an empty result; other
columns are ignored; texts are read whole, words of any length are vocabulary.
"""

from __future__ import annotations

import math
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coalis.operators.skew import attach
from coalis.sources.scratch import Scratch, small_or_shuffled

#: White space and invisible characters around a text.
EDGE = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cf", "Cc"))
#: Closing quotes and brackets that may follow a sentence's end.
CLOSERS = "”“»\"'’)]"
_CLOSE = "[”“»\"'’)\\]]"
_SENTENCE = rf"(?<=[.!?…])\s*{_CLOSE}*\s+"
_SYMBOL = r"[\p{So}\p{Sk}\p{Sm}\p{Sc}*_~|#]"
_NOTE = rf"(\[[^\[\]]*+\]|\([^()]*+\)|<[^<>]*+>|[:;]-?[)(]|(?<!{_SYMBOL}){_SYMBOL}++)$"
_NOTE_LAST = rf"[\])>(]|{_SYMBOL}"
_ATTRIBUTION = r"\s[–—-]{1,3}\s+\p{Lu}[\p{L}\p{M}]+$"
_LIST_MARK = r"^([-•*–]\s+|\(?\d{1,4}[.)]\s+)"
_BETWEEN = r"[^\p{L}\p{N}\p{M}’'-]+"
#: Quotes and hyphens that are not inside a word.
LOOSE = "’'-"

#: Share of all words from which a word's statistics count.
LEAST = 400e-6
#: Share of all words from which a word can be the one a fragment starts, and the most a fragment
#: may occur as a word of its own, as a part of that word's occurrences.
STARTED, FRAGMENT = 100e-6, 0.02
#: Length up to which every start of a word is listed.
SHORT = 64
#: Part of the single unfinished lines in which a predicate may stand, as some are cut sentences.
STRAY = 0.005

#: Kinds of endings with the log odds the fit starts from; None: whole by definition.
KINDS: dict[str, float | None] = {
    "finished": None,
    "noted": None,
    "ellipsis_closed": None,
    "ellipsis": -2.0,
    "ellipsis_inside": 4.0,
    "dots": 0.0,
    "dots_inside": 4.0,
    "inside": 5.0,
    "later_sentence": 5.0,
    "clause": 3.0,
    "heading": -4.0,
}
#: Endings that are surely cut, those without a mark behind a cut, and such marks.
INSIDE = ("inside", "ellipsis_inside", "dots_inside")
UNMARKED = ("inside", "later_sentence", "clause", "heading")
MARKS = ("ellipsis", "dots")
#: Part of the texts of a kind that the fit leaves as the start says.  Headings look alike in
#: every source, so the fit alone could not tell them from lines cut before their predicate.
LEAN, LEAN_HEADING = 0.02, 0.3
#: Bins of the rates and posteriors the fit sees, and log odds beyond which nothing is told apart.
RATE_BINS, POSTERIOR_BINS, SURE = 48, 24, 12.0


def censored_fit(lengths: np.ndarray, counts: np.ndarray, limits: list[int], rounds: int = 60) -> tuple[float, float, np.ndarray, np.ndarray, float]:
    """(mu, sigma, parts, posteriors, gain): maximum-likelihood log-normal with a part of the longer texts cut to each limit.

    A text takes the way of limit k with probability ``parts[k]``, where it is cut to the limit
    if it is longer.  ``posteriors[k]`` is the probability that a text of the limit's length was
    cut, ``gain`` the log likelihood over the best fit without limits.
    """
    x, n = np.log(lengths), counts.astype(float)
    at = np.searchsorted(lengths, limits)
    c = np.log(np.asarray(limits, float))
    total = n.sum()

    def density(values, mu, sigma):
        return np.exp(-0.5 * ((values - mu) / sigma) ** 2 - values) / (sigma * math.sqrt(2 * math.pi))

    mu = (n * x).sum() / total
    sigma = max(math.sqrt((n * (x - mu) ** 2).sum() / total), 0.05)
    tiny = 1e-300
    plain = (n * np.log(density(x, mu, sigma) + tiny)).sum()
    hits = n[at]
    longer = np.array([n[lengths > limit].sum() for limit in limits])
    parts = np.clip(0.5 * hits / (hits + longer), 1e-6, 0.9)
    parts /= max(parts.sum() / 0.9, 1.0)
    reach = lengths[:, None] <= np.asarray(limits)[None, :]  # the ways on which a length is stored uncut

    def state():
        z = (c - mu) / sigma
        tails = np.array([max(0.5 * math.erfc(v / math.sqrt(2)), 1e-12) for v in z])
        free = 1 - parts.sum() + reach @ parts
        f = density(x, mu, sigma)
        cut, uncut = parts * tails, f[at] * free[at]
        return z, tails, free, f, cut, uncut

    for _ in range(rounds):
        z, tails, free, f, cut, uncut = state()
        post = cut / (cut + uncut + tiny)
        ratio = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tails
        # moments of a log length known only to be over the limit
        m1 = mu + sigma * ratio
        m2 = mu * mu + sigma * sigma + sigma * ratio * (c + mu)
        w, extra = n.copy(), hits * post
        w[at] = hits * (1 - post)
        mu = ((w * x).sum() + (extra * m1).sum()) / total
        second = ((w * x * x).sum() + (extra * m2).sum()) / total
        sigma = max(math.sqrt(max(second - mu * mu, 0)), 0.05)
        # a text stored uncut took one of the ways that reach it
        ways = extra + parts * (reach * (w / np.maximum(free, tiny))[:, None]).sum(0)
        parts = np.clip(ways / total, 1e-9, 1)
        parts /= max(parts.sum() / 0.999, 1.0)
    _, _, free, f, cut, uncut = state()
    likely = f * free
    likely[at] += cut
    fitted = (n * np.log(likely + tiny)).sum()
    return mu, sigma, parts, cut / (cut + uncut + tiny), fitted - plain


def _limits_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """All limits of one source and unit from its length histogram."""
    pdf = pdf[pdf["length"] > 0].sort_values("length")
    lengths, counts, opened = (pdf[c].to_numpy(np.int64) for c in ("length", "n", "open"))
    empty = pd.DataFrame(columns=["source", "unit", "length", "posterior", "part", "mu", "sigma"])
    if not len(lengths):
        return empty
    # lengths within a tenth tell what one length usually has, and how much that varies
    lo, hi = np.searchsorted(lengths, np.ceil(lengths * 0.9)), np.searchsorted(lengths, np.floor(lengths * 1.1), "right")
    around = lambda v: (lambda c: c[hi] - c[lo] - v)(np.concatenate([[0], np.cumsum(v)])) / np.maximum(0.2 * lengths, 1)
    usual = np.maximum(around(counts), 0.2)
    spread = np.sqrt(np.maximum(around(counts**2) - usual**2, usual))
    able = (opened * 2 >= counts) & (counts >= 3 * usual) & (counts - usual >= 4 * spread + 3)
    limits = lengths[able].tolist()
    while limits:
        mu, sigma, parts, posteriors, gain = censored_fit(lengths, counts, limits)
        # a limit must pay for itself: without it the others must explain the lengths worse
        kept = [k for k in range(len(limits)) if posteriors[k] > 0.5]
        if len(kept) == len(limits):
            break
        limits = [limits[k] for k in kept]
    if not limits or gain < 5 * len(limits):
        return empty
    # a cut that falls on a blank loses it: such texts are one shorter
    trimmed_to = [c - 1 for c in limits if c - 1 in lengths and c - 1 not in limits]
    if trimmed_to:
        limits = sorted(limits + trimmed_to)
        mu, sigma, parts, posteriors, gain = censored_fit(lengths, counts, limits)
    return pd.DataFrame({"source": pdf["source"].iloc[0], "unit": pdf["unit"].iloc[0], "length": limits, "posterior": np.minimum(posteriors, 0.999), "part": parts, "mu": mu, "sigma": sigma})


LIMITS = "source string, unit string, length long, posterior double, part double, mu double, sigma double"
UNITS = ("chars", "bytes", "body_chars", "body_bytes")


def field_limits(endings: DataFrame) -> DataFrame:
    """(source, unit, length, posterior, part, mu, sigma): the limits each source's lengths show.

    ``endings`` has source, the lengths of :data:`UNITS`, text_hash and kind.  Copies of a text
    count once, as they say no more about a limit than one.  A histogram has one row per distinct
    length, so a group is bounded by the longest text.
    """
    opened = (~F.col("kind").isin("finished", "noted", "ellipsis_closed")).cast("int")
    t = endings.select("source", "text_hash", *UNITS, opened.alias("open")).distinct()
    t = t.select("source", "open", F.posexplode(F.array(*[F.col(u).cast("long") for u in UNITS])).alias("u", "length"))
    histogram = t.groupBy("source", F.element_at(F.array(*[F.lit(u) for u in UNITS]), F.col("u") + 1).alias("unit"), "length").agg(F.count("*").alias("n"), F.sum("open").alias("open"))
    return histogram.groupBy("source", "unit").applyInPandas(_limits_of, LIMITS)


def trimmed(text: Column) -> Column:
    """The text without white space and invisible characters around it."""
    return F.btrim(text, F.lit(EDGE))


def _words(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), _BETWEEN), lambda w: F.btrim(w, F.lit(LOOSE))), lambda w: w != "")


def _tail(text: Column) -> Column:
    """What follows the last blank."""
    return F.substring_index(text, " ", -1)


def endings_of(documents: DataFrame) -> DataFrame:
    """One row per text with its lengths, the marks of its ending and the words of its sentences; each text is walked once."""
    body = trimmed(F.col("text"))
    lengths = [F.length("text").alias("chars"), F.octet_length("text").alias("bytes")]
    t = documents.where(F.col("text").isNotNull()).select("doc_id", "source", *lengths, body.alias("body")).where("body <> ''")
    core = F.rtrim(F.col("body"), F.lit(CLOSERS + EDGE))
    listed = F.when(F.left("body", F.lit(1)).rlike(r"[-•*–(\d]"), F.regexp_replace("body", _LIST_MARK, "")).otherwise(F.col("body"))
    t = t.select("*", core.alias("core"), F.split(listed, _SENTENCE).alias("parts"))
    t = t.select("*", F.right("core", F.lit(1)).isin(".", "!", "?", "…").alias("finished"), F.rtrim(F.col("core"), F.lit("…." + EDGE)).alias("stem"))
    # the last quote: an opening one, or “ where it does not close a „
    last_quote = F.regexp_extract(F.reverse("body"), "[“«„”»]", 0)
    openers = F.when(F.col("body").contains("„"), "«„").otherwise("«„“")
    inner = lambda mark: F.size(F.filter("parts", lambda p, i: F.endswith(p, F.lit(mark)) & (i < F.size("parts") - 1)))
    capital = _tail(F.col("stem")).rlike(r"(?<![\p{L}\p{N}\p{M}’'-])\p{Lu}[\p{L}\p{N}\p{M}’'-]*$")
    return t.select(
        "doc_id",
        "source",
        "chars",
        "bytes",
        F.length("body").alias("body_chars"),
        F.octet_length("body").alias("body_bytes"),
        F.xxhash64("body").alias("text_hash"),
        "finished",
        F.when(F.col("core").endswith("…"), "ellipsis").when(F.col("core").endswith(".."), "dots").alias("dots"),
        (F.length("core") < F.length("body")).alias("closed"),
        ((F.right("body", F.lit(1)).rlike(_NOTE_LAST) & F.col("body").rlike(_NOTE)) | (~F.col("finished") & capital & F.col("body").rlike(_ATTRIBUTION))).alias("noted"),
        (
            F.right("body", F.lit(1)).isin(",", ";", ":")
            | F.right("body", F.lit(2)).rlike(r"^[\s(«][“„«(\[]$")
            | _tail(F.col("body")).rlike(r"&[#\w]*$")
            | F.right("body", F.lit(13)).rlike(r"[<\[(][^<>()\[\]]{0,12}$")
        ).alias("hanging"),
        capital.alias("capital"),
        F.when(F.col("body").rlike("[“«„]"), F.contains(openers, last_quote)).otherwise(False).alias("quoted"),
        F.filter(F.transform("parts", _words), lambda w: F.size(w) > 0).alias("sentences"),
        (F.size("parts") - 1).alias("inner_ends"),
        F.when(F.col("body").contains("…"), inner("…") - F.regexp_count("body", F.lit(rf"…\s*{_CLOSE}+\s"))).otherwise(0).alias("inner_ellipsis"),
        F.when(F.col("body").contains(".."), inner("..")).otherwise(0).alias("inner_dots"),
    )


def word_statistics(endings: DataFrame) -> DataFrame:
    """(word, n, inner, ends, p1, p2, p3, lines, ...): counts over all sentences.

    ``inner`` leaves out the last word of every text, ``ends`` counts last words of finished
    sentences, ``p1`` to ``p3`` occurrences at that place of a finished sentence, ``lines``
    occurrences in texts that are one unfinished sentence.
    """
    parts = endings.select("finished", F.size("sentences").alias("of_parts"), F.posexplode("sentences").alias("part", "w")).where(F.size("w") > 0)
    latest = F.col("part") == F.col("of_parts") - 1
    digits = F.coalesce(F.get("w", F.lit(0)) < ":", F.lit(False)) | F.coalesce(F.get("w", F.lit(1)) < ":", F.lit(False))  # ASCII digits sort before the colon
    each = parts.select(
        F.posexplode("w").alias("at", "word"), F.size("w").alias("of"), (~latest | F.col("finished")).alias("whole"), (~F.col("finished") & (F.col("of_parts") == 1)).alias("line"), latest.alias("last"), digits.alias("digits")
    )
    ending = F.col("at") == F.col("of") - 1
    one = lambda c: F.count_if(c)
    return (
        each.groupBy("word")
        .agg(
            F.count("*").alias("n"),
            one(~ending | ~F.col("last")).alias("inner"),
            one(F.col("whole")).alias("whole_n"),
            one(F.col("whole") & ending).alias("ends"),
            one(F.col("whole") & (F.col("at") == 1) & ~ending).alias("p1"),
            one(F.col("whole") & (F.col("at") == 2) & ~ending & ~F.col("digits")).alias("p2"),
            one(F.col("whole") & (F.col("at") == 3)).alias("p3"),
            one(F.col("line")).alias("lines"),
            one(F.col("whole") & (F.col("at") == 0)).alias("first"),
            one(F.col("line") & (F.col("at") == 0)).alias("first_line"),
        )
    )


def _told(endings: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, source, text_hash, lengths, kind) of every text."""
    statistics = scratch.write(word_statistics(endings), "words")
    total, sentences, lines = (x or 0 for x in statistics.agg(F.sum("n"), F.sum("first"), F.sum("first_line")).first())
    limit = max(total // 2000, 1000)
    known_well = F.col("whole_n") >= LEAST * total
    grade = statistics.select(
        "word",
        "n",
        "inner",
        (known_well & (F.col("ends") < 0.002 * F.col("whole_n"))).alias("never_last"),
        (
            known_well
            & ((F.col("p2") >= 0.2 * F.col("whole_n")) | (F.col("p1") >= 0.7 * F.col("whole_n")) | (F.col("p3") >= 0.7 * F.col("whole_n")))
            & (F.col("lines") * sentences <= (0.5 * F.col("whole_n") + STRAY * sentences) * lines)
            & ~F.col("word").rlike("^[0-9]")
        ).alias("predicate"),
    )
    grade = scratch.write(grade, "grades")
    often = grade.where(F.col("inner") >= STARTED * total).select(F.col("word").alias("of"), F.col("inner").alias("started"))  # at most 1 / STARTED words
    short = often.select(F.explode(F.sequence(F.lit(1), F.least(F.length("of") - 1, F.lit(SHORT)))).alias("i"), "of", "started").where("i between 1 and length(of) - 1").select(F.expr("left(of, i)").alias("word"), "started")
    # a longer fragment is compared with the words of its first SHORT characters
    long = grade.where(F.length("word") > SHORT).select("word", F.substring("word", 1, SHORT).alias("head"))
    long = long.join(small_or_shuffled(often.where(F.length("of") > SHORT).select("of", "started", F.substring("of", 1, SHORT).alias("head"))), "head").where(F.startswith("of", "word") & (F.col("of") != F.col("word"))).select("word", "started")
    starts = small_or_shuffled(short.unionByName(long).groupBy("word").agg(F.max("started").alias("started")))
    ends = grade.join(starts, "word", "left").select("word", "n", "never_last", F.coalesce(F.col("inner") <= FRAGMENT * F.col("started"), F.lit(False)).alias("fragment"))

    marks = endings.withColumn("last", F.element_at("sentences", -1)).withColumn("single", F.size("sentences") == 1)
    open_ends = marks.where("not noted and (not finished or dots is not null)")
    last = attach(open_ends.where(F.size("last") > 0).select("doc_id", F.element_at("last", -1).alias("word")), ["word"], ends, limit)
    unclear = open_ends.where("not finished and single").select("doc_id", F.explode(F.array_distinct("last")).alias("word"))
    clauses = attach(unclear, ["word"], grade.where("predicate").select("word", "n"), limit).select("doc_id").distinct().withColumn("clause", F.lit(True))
    known = marks.drop("sentences", "last").join(last.select("doc_id", "never_last", "fragment"), "doc_id", "left").join(clauses, "doc_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    # a capitalised word may be a name or noun that only happens never to end a sentence
    inside = (flag("never_last") & ~F.col("capital")) | flag("fragment") | F.col("quoted")
    dotted = F.col("dots")
    kind = (
        F.when(F.col("noted"), "noted")
        .when(F.col("finished") & dotted.isNull(), "finished")
        .when(F.col("finished") & inside, F.concat(dotted, F.lit("_inside")))
        .when(F.col("finished") & F.col("closed"), "ellipsis_closed")
        .when(F.col("finished"), dotted)
        .when(F.col("hanging") | inside, "inside")
        .when(~F.col("single"), "later_sentence")
        .when(flag("clause"), "clause")
        .otherwise("heading")
    )
    return scratch.write(known.select("doc_id", "source", "text_hash", *UNITS, kind.alias("kind")), "told")


def fit_endings(table: pd.DataFrame, inner: dict[str, float], rounds: int = 40) -> dict:
    """EM over (rate_bin, rate, posterior, kind, n) counts.

    ``inner`` is how often a sentence inside of a text ends in each mark, as a part of the plain
    ones.  Returns ``at_limit`` and ``elsewhere`` (log ratio of each kind to whole texts),
    ``between`` (part of limits between sentences), ``rates`` of the rate bins and the
    ``overall`` rate.
    """
    names = list(KINDS)
    index = table["kind"].map({k: i for i, k in enumerate(names)}).to_numpy()
    n, posterior, bins = (table[c].to_numpy(float) for c in ("n", "posterior", "rate_bin"))
    rate = table["rate"].to_numpy(float).copy()
    able = np.array([KINDS[k] is not None for k in names])
    start = np.array([KINDS[k] or 0.0 for k in names])
    lean = np.where(able, 1 / (1 + np.exp(-start)), 0.0)
    known = np.array([names.index(k) for k in inner], int)
    known_part = np.array(list(inner.values()))
    count = np.bincount(index, n, len(names))
    share = lambda c: c / max(c.sum(), 1e-300)
    left = np.array([LEAN_HEADING if k == "heading" else LEAN for k in names])
    surely = [names.index(k) for k in INSIDE]
    seen = np.maximum(count, 1e-4 * count.sum())
    cut_elsewhere = cut_at_limit = share(seen * lean)
    whole, between = share(seen * (1 - lean)), 0.1
    for _ in range(rounds):
        l = posterior * (1 - between) * cut_at_limit[index]
        e = (1 - posterior) * rate * cut_elsewhere[index]
        b = posterior * between * whole[index]
        w = (1 - posterior) * (1 - rate) * whole[index]
        every = np.maximum(l + e + b + w, 1e-300)
        l, e, b, w = (n * x / every for x in (l, e, b, w))
        # a fixed part of each kind's texts stays as the start says, whatever the size of the corpus
        held = left * seen
        in_limit, in_else, in_whole = (np.bincount(index, x, len(names)) for x in (l, e, b + w))
        cut_at_limit = share((1 - left) * in_limit + held * lean * in_limit.sum() / max(in_limit.sum() + in_else.sum(), 1e-9))
        in_else = (1 - left) * in_else + held * lean * in_else.sum() / max(in_limit.sum() + in_else.sum(), 1e-9)
        # a mark behind a cut does not change where it falls
        told = in_else[names.index("inside")] / max(sum(in_else[names.index(k)] for k in UNMARKED), 1e-300)
        for mark in MARKS:
            at, behind = names.index(mark), names.index(f"{mark}_inside")
            marked = in_else[at] + in_else[behind]
            in_else[at], in_else[behind] = (1 - told) * marked, told * marked
        cut_elsewhere = share(in_else)
        sure = cut_elsewhere[surely].sum()
        in_whole = (1 - left) * in_whole + held * (1 - lean)
        plain = in_whole[names.index("finished")]
        in_whole[known] = known_part * plain
        whole = share(in_whole)
        between = (b.sum() + 0.5) / (b.sum() + l.sum() + 1)
        for r in np.unique(bins):
            here = bins == r
            # only sure cuts tell a source's rate
            rate[here] = np.clip(e[here & np.isin(index, surely)].sum() / max(sure * (n * (1 - posterior))[here].sum(), 1e-9), math.exp(-SURE), 0.9)
    ratio = lambda c: dict(zip(names, np.clip(np.log(np.maximum(c, 1e-12) / np.maximum(whole, 1e-12)), -SURE, SURE).tolist(), strict=True))
    return {
        "at_limit": ratio(cut_at_limit),
        "elsewhere": ratio(cut_elsewhere),
        "between": float(between),
        "rates": {int(r): float(rate[bins == r][0]) for r in np.unique(bins)},
        "overall": float((l.sum() + e.sum()) / max(n.sum(), 1)),
    }


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, kind, posterior, score, by_ending): log odds of every text; positive means cut off.

    ``by_ending`` is the score with the overall rate as prior, that is without the length evidence.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "truncation")
    endings = scratch.write(endings_of(documents), "endings")
    ends, ellipses, dots = (x or 0 for x in endings.agg(F.sum("inner_ends"), F.sum("inner_ellipsis"), F.sum("inner_dots")).first())
    inner = {"ellipsis": (max(ellipses, 0) + 1) / (ends + 1), "dots": (dots + 1) / (ends + 1)}
    told = _told(endings, scratch)
    scratch.drop("endings", "words", "grades")
    limits = scratch.write(field_limits(told), "limits")
    scored = told
    for u in UNITS:
        at = small_or_shuffled(limits.where(F.col("unit") == u).select(F.col("source").alias(f"_{u}"), F.col("length").alias(f"l_{u}"), F.col("posterior").alias(f"p_{u}")))
        scored = scored.join(at, (F.col(u) == F.col(f"l_{u}")) & F.col("source").eqNullSafe(F.col(f"_{u}")), "left")
    posterior = F.coalesce(F.greatest(*[F.col(f"p_{u}") for u in UNITS]), F.lit(0.0))
    scored = scratch.write(scored.select("doc_id", "source", "kind", posterior.alias("posterior")), "scored")
    # a source's rate away from limits to begin with: its surely cut texts, in bins of its logarithm
    free = F.col("posterior") < 0.5
    sure = F.col("kind").isin(*INSIDE)
    rate = (F.count_if(free & sure) + 0.02) / (F.count_if(free) + 1.0)
    of_source = scored.groupBy("source").agg(rate.alias("rate")).select(F.col("source").alias("_source"), F.least(F.lit(RATE_BINS - 1), F.floor(-4 * F.log("rate"))).cast("int").alias("rate_bin"))
    of_source = scratch.write(of_source, "sources")
    step = F.round(F.col("posterior") * POSTERIOR_BINS) / POSTERIOR_BINS
    binned = scored.join(small_or_shuffled(of_source), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    table = binned.groupBy("rate_bin", F.least(step, F.lit(0.999)).alias("posterior"), "kind").agg(F.count("*").alias("n")).toPandas()  # at most RATE_BINS * POSTERIOR_BINS * kinds rows
    if not len(table):
        return scored.withColumn("score", F.lit(0.0)).withColumn("by_ending", F.lit(0.0))
    table["rate"] = np.exp(-(table["rate_bin"] + 0.5) / 4)
    fit = fit_endings(table.sort_values(["rate_bin", "kind", "posterior"], ignore_index=True), inner)
    literal = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    able = F.col("kind").isin(*[k for k, v in KINDS.items() if v is not None])
    ratio = lambda of: F.exp(literal(fit[of])[F.col("kind")])
    p, rate = F.col("posterior"), literal(fit["rates"])[F.col("rate_bin")]
    cut = p * (1 - fit["between"]) * ratio("at_limit") + (1 - p) * rate * ratio("elsewhere")
    whole = p * fit["between"] + (1 - p) * (1 - rate)
    alone = fit["overall"] / (1 - fit["overall"]) * F.greatest(ratio("at_limit"), ratio("elsewhere"))
    score = lambda odds: F.when(able, F.log(F.greatest(odds, F.lit(math.exp(-2 * SURE))))).otherwise(-2 * SURE)
    return binned.select("doc_id", "source", "kind", "posterior", score(cut / whole).alias("score"), score(alone).alias("by_ending"))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of the texts that lack their end."""
    return judged(documents).where("score > 0").select("doc_id")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, n_documents, n_truncated, share) over all texts of each source."""
    cut = judged(documents).where("score > 0").groupBy("source").agg(F.count("*").alias("n_truncated"))
    every = documents.groupBy("source").agg(F.count("*").alias("n_documents"))
    joined = every.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    n = F.coalesce("n_truncated", F.lit(0))
    return joined.select("source", "n_documents", n.alias("n_truncated"), (n / F.col("n_documents")).alias("share"))
