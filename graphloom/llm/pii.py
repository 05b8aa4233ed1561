"""Personal data by weak supervision, with DataFrame functions alone.

Strict patterns give the base spans. Wider patterns give further candidates: spelled-out addresses,
national phone numbers, card numbers with other separators, IPv6 addresses, and what strict patterns
matched but checks refused. Labelers vote on every candidate, base spans included: a pattern labeler, a
gazetteer (top-level domains, calling codes, issuer prefixes), a context labeler (cue words before the
span) and a shape labeler. Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability without labels; its posteriors train the final span classifier, a naive Bayes
over votes and features of the span. Candidates that it is sure of are added; base spans stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns of the base. ``\G`` or a lookbehind only spares scanning a run of characters again
#: from its middle, and possessive loops only spare backtracking that can't succeed.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, of bounded length each.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?[\[({] ?dot ?[\])}] ?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
_TRIGGER = {"email": "@", "phone": "+"}

TLDS = "com org net edu gov mil int info biz io co app dev me tv uk de fr es it nl be at ch pl se no dk fi pt ie eu us ca au nz jp cn kr in br mx ar ru ua za".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 420 421 852 886 971 972".split()
CUES = {
    "email": "email e-mail mail contact write reach address courriel correo",
    "ip": "ip host address server client login",
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta",
    "phone": "phone tel telephone call mobile cell fax sms whatsapp telefon teléfono téléphone",
}
COUNTER_CUES = "version release chapter section figure table page isbn issn doi serial order invoice sha md5 build rfc"
#: Code points before a span in which cue words count.
BEFORE = 40
#: Pieces or spans of a text that are gone through together.
STRIDE = 256
ROUNDS = 12
SURE = 0.95

_OPEN, _SHUT = "\ue000", "\ue001"
_VOTERS = ("v_pattern", "v_gazetteer", "v_context", "v_shape")
_FEATURES = (*_VOTERS, "f_length", "f_digits", "f_left")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    weighed = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))
    return F.aggregate(weighed, F.lit(0), lambda s, v: s + v) % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    """Whether a match of the strict pattern passes the checks of its kind."""
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(x, r"\."), lambda p: F.substring(F.regexp_replace(p, "^0+", "0"), -4, 4).cast("int") <= 255)
    many = F.length(_digits(x))
    if kind == "card":
        return many.between(12, 19) & _luhn(_digits(x))
    return many.between(9, 15) if kind == "phone" else F.lit(True)


def pieces(text: Column, pattern: str) -> Column:
    """The text cut before each leftmost non-overlapping match, whose end is marked."""
    marked = F.regexp_replace(F.translate(text, _OPEN + _SHUT, "??"), f"({pattern})".replace(r"\1", r"\2"), f"{_OPEN}$1{_SHUT}")
    return F.split(marked, _OPEN)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, wherever and how often ``f`` uses it, also within lambdas."""
    return F.transform(F.array(value), f)[0]


def matches(cut_up: Column) -> Column:
    """The matches in ``pieces``, in order: ``start`` (code points), ``match`` and what stands ``before``.

    Positions are running lengths. They are summed within strides of pieces, from the sums of the strides
    before, so that the work grows with the matches of a text and not with their square.
    """
    parts = F.transform(cut_up, lambda p, i: F.struct(F.when(i > 0, F.substring_index(p, _SHUT, 1)).otherwise("").alias("match"), p.alias("piece")))
    parts = F.transform(parts, lambda x: F.struct(x["match"].alias("match"), F.when(x["match"] == "", x["piece"]).otherwise(F.substring(x["piece"], F.length(x["match"]) + 2, F.length(x["piece"]))).alias("rest")))
    sized = F.transform(parts, lambda x: F.struct(x["match"].alias("match"), F.right(F.concat(x["match"], F.right(x["rest"], F.lit(BEFORE))), F.lit(BEFORE)).alias("tail"), (F.length(x["match"]) + F.length(x["rest"])).alias("n")))
    none = F.array().cast("array<struct<start:int,match:string,before:string>>")

    def step(s: Column, x: Column) -> Column:
        found = F.struct(s["at"].alias("start"), x["match"].alias("match"), s["before"].alias("before"))
        out = F.when(x["match"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(found)))
        return F.struct((s["at"] + x["n"]).alias("at"), F.right(F.concat(s["before"], x["tail"]), F.lit(BEFORE)).alias("before"), out.alias("out"))

    def of(sized: Column) -> Column:
        # A piece has a code point at least (but for the first), so as many of them as BEFORE reach far enough back.
        first = lambda at: F.greatest(at - BEFORE - 1, F.lit(1))
        lead = lambda at: F.right(F.array_join(F.transform(F.slice(sized, first(at), at - first(at)), lambda x: x["tail"]), ""), F.lit(BEFORE))
        starts = F.sequence(F.lit(1), F.greatest(F.size(sized), F.lit(1)), F.lit(STRIDE))
        strides = F.transform(starts, lambda at: F.struct(lead(at).alias("before"), F.slice(sized, at, F.lit(STRIDE)).alias("own")))

        def all_of(strides: Column) -> Column:
            lengths = F.transform(strides, lambda s: F.aggregate(s["own"], F.lit(0), lambda n, x: n + x["n"]))
            sums = F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
            one = lambda sums: (lambda s, k: F.aggregate(s["own"], F.struct(F.get(sums, k).alias("at"), s["before"].alias("before"), none.alias("out")), step, lambda x: x["out"]))
            return let(sums, lambda sums: F.flatten(F.transform(strides, one(sums))))

        return let(strides, all_of)

    return let(sized, of)


def _as_spans(found: Column, kind: str, strict: bool) -> Column:
    no = KINDS.index(kind)
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["match"])).alias("stop"), m["match"].alias("match"), m["before"].alias("before"),
            (_holds(kind, m["match"]) if strict else F.lit(False)).alias("strict"), F.lit(strict).alias("refused"),
        ),
    )


_SPAN = "array<struct<start:int,no:int,kind:string,stop:int,match:string,before:string,strict:boolean,refused:boolean>>"


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (the base spans) and ``wide`` (other candidates, none of which meets a base span)."""
    # In steps: an expression that is used more than once is a column of its own.
    text, digit = F.col("text"), F.col("_digit")
    spelled = F.contains(F.lower(text), F.lit("dot")) & text.rlike(r"[\[({] ?at ?[\])}]")
    asked = {f"_strict_{k}": (STRICT[k], F.contains(text, F.lit(_TRIGGER[k])) if k in _TRIGGER else digit) for k in KINDS}
    asked |= {f"_wide_{k}": (WIDE[k], spelled if k == "email" else digit) for k in KINDS}
    out = docs.withColumn("_digit", text.rlike("[0-9]"))
    out = out.withColumns({c: F.when(may, pieces(text, pattern)) for c, (pattern, may) in asked.items()})
    out = out.withColumns({c: F.when(F.size(c) > 1, matches(F.col(c))) for c in asked})
    none = F.array().cast(_SPAN)
    out = out.withColumns({c: F.coalesce(_as_spans(F.col(c), c.rsplit("_", 1)[1], c.startswith("_strict")), none) for c in asked})
    out = out.withColumn("_strict", F.concat(*(F.col(f"_strict_{k}") for k in KINDS))).withColumn("_wide", F.concat(*(F.col(f"_wide_{k}") for k in KINDS)))
    out = out.withColumn("base", F.sort_array(F.filter("_strict", lambda s: s["strict"])))
    others = F.concat(F.filter("_strict", lambda s: ~s["strict"]), F.col("_wide"))
    return out.withColumn("wide", F.sort_array(clear(others, F.col("base")))).drop("_digit", "_strict", "_wide", *asked)


def clear(others: Column, base: Column) -> Column:
    """Those of the spans ``others`` that meet none of ``base``, which are sorted.

    Base spans are gone through in strides, each with its bounds: most are passed over without a look at their spans.
    """
    crosses = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    starts = F.sequence(F.lit(1), F.greatest(F.size(base), F.lit(1)), F.lit(STRIDE))
    own = F.transform(starts, lambda at: F.transform(F.slice(base, at, F.lit(STRIDE)), lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"))))
    strides = F.transform(own, lambda x: F.struct(F.array_min(F.transform(x, lambda b: b["start"])).alias("start"), F.array_max(F.transform(x, lambda b: b["stop"])).alias("stop"), x.alias("spans")))
    meets = lambda s, strides: F.exists(strides, lambda x: F.when(crosses(x, s), F.exists(x["spans"], lambda b: crosses(b, s))).otherwise(False))
    return F.when(F.size(others) == 0, others).otherwise(let(strides, lambda strides: F.filter(others, lambda s: ~F.coalesce(meets(s, strides), F.lit(False)))))


def _words_of(text: str) -> str:
    return "(?iU)(?<![\\p{L}])(?:" + "|".join(w.replace("-", "\\-") for w in text.split()) + ")(?![\\p{L}])"


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def features(s: Column) -> dict[str, Column]:
    """Votes (1, 0 or -1) and features of a candidate."""
    kind, match, before = s["kind"], s["match"], s["before"]
    digits = _digits(match)
    many = F.length(digits)
    tld = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)[\])}]?$", 1)).isin(TLDS)
    code = F.exists(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(digits, F.lit(1), n).isin(CALLING_CODES))
    issuer = digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)")
    octet = digits.rlike("[1-9]")
    known = F.when(kind == "email", tld).when(kind == "card", issuer).when(kind == "ip", octet).otherwise(F.when(F.startswith(match, F.lit("+")), code).otherwise(digits.rlike("^[2-9]")))
    cued = F.lit(False)
    for k, cues in CUES.items():
        cued = F.when(kind == k, before.rlike(_words_of(cues))).otherwise(cued)
    shaped = F.when(kind == "email", match.rlike(r"^[A-Za-z]")).when(kind == "card", many.between(13, 19) & _luhn(digits)).when(kind == "phone", many.between(9, 12)).otherwise(F.lit(True))
    return {
        "v_pattern": _vote(s["strict"], s["refused"]),
        "v_gazetteer": _vote(known, ~known),
        "v_context": _vote(cued, before.rlike(_words_of(COUNTER_CUES))),
        "v_shape": _vote(shaped, ~shaped),
        "f_length": F.least(F.length(match) / 8, F.lit(5)).cast("int"),
        "f_digits": F.least(many / 5, F.lit(4)).cast("int"),
        "f_left": F.when(before == "", 0).when(before.rlike(r"[\s]$"), 1).when(before.rlike(r"[\p{L}\p{N}]$"), 2).otherwise(3),
    }


def patterns(found: DataFrame) -> DataFrame:
    """Counts of candidates (``base``, ``wide``) by kind, votes and features: a table of bounded size whatever the corpus."""
    each = found.select(F.explode(F.concat("base", "wide")).alias("s"))
    each = each.select(F.col("s.kind").alias("kind"), *(c.cast("int").alias(n) for n, c in features(F.col("s")).items()))
    return each.groupBy("kind", *_FEATURES).agg(F.count("*").cast("double").alias("n"))


def _learned(counted: list, posterior: list[float], names: tuple[str, ...]) -> tuple[dict, float]:
    """Smoothed log-odds of each value of each name, and the constant, with patterns weighed by posterior."""
    yes = sum(r["n"] * p for r, p in zip(counted, posterior, strict=True))
    no = sum(r["n"] * (1 - p) for r, p in zip(counted, posterior, strict=True))
    out = {}
    for name in names:
        for v in _VALUES[name]:
            own = [(r["n"], p) for r, p in zip(counted, posterior, strict=True) if r[name] == v]
            k = len(_VALUES[name])
            out[name, v] = math.log((sum(n * p for n, p in own) + 1) / (yes + k)) - math.log((sum(n * (1 - p) for n, p in own) + 1) / (no + k))
    return out, math.log((yes + 1) / (no + 1))


_VALUES = {v: (-1, 0, 1) for v in _VOTERS} | {"f_length": tuple(range(6)), "f_digits": tuple(range(5)), "f_left": tuple(range(4)), "kind": KINDS}


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def classifier(found: DataFrame) -> tuple[dict, float] | None:
    """The span classifier's weights and constant; none where the corpus has no candidates.

    Counting the patterns goes over all documents; what is left to do goes over the counts.
    """
    counted = sorted(patterns(found).collect(), key=lambda r: tuple(r)[:-1])  # of bounded size: values of votes and features
    if not counted:
        return None
    # First guess: the balance of votes, the pattern labeler's counting twice.
    posterior = [_logistic(2.0 * r["v_pattern"] + r["v_gazetteer"] + r["v_context"] + r["v_shape"] - 0.5) for r in counted]
    for _ in range(ROUNDS):
        weights, constant = _learned(counted, posterior, _VOTERS)
        posterior = [_logistic(constant + sum(weights[v, r[v]] for v in _VOTERS)) for r in counted]
    return _learned(counted, posterior, (*_FEATURES, "kind"))


def _odds(weights: dict[tuple[str, object], float], constant: float, values: dict[str, Column]) -> Column:
    """Sum of the weights of what a candidate's votes and features are."""
    out = F.lit(constant)
    for name, value in values.items():
        case = F.lit(0.0)
        for v in _VALUES[name]:
            case = F.when(value == v, F.lit(weights[name, v])).otherwise(case)
        out = out + case
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256`` (of the
    base spans as ``kind:start:end``, by start, then kind), ``spans`` (base and added, written likewise),
    ``n_added`` and ``added``. Positions are code points, ends exclusive. Null and empty texts have no
    spans; rows that repeat or have no ``doc_id`` are treated each on its own; the private-use
    characters U+E000 and U+E001 count as one other character each. Spans that begin together are
    ordered by kind. A text of any length is gone through whole, in time that grows with it. An empty table
    gives no rows. Other columns, of whatever name, are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Texts are gone through once: what is left of them are their spans.
    out = Scratch(docs.sparkSession).table(with_candidates(docs).select("doc_id", "base", "wide"), "candidates")
    trained = classifier(out)
    if trained is None:
        added = F.filter("wide", lambda s: F.lit(False))
    else:
        weights, constant = trained

        def sure(s: Column) -> Column:
            return _odds(weights, constant, features(s) | {"kind": s["kind"]}) >= math.log(SURE / (1 - SURE))

        added = F.filter("wide", sure)
    out = out.select("doc_id", "base", added.alias("added"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), _joined(F.col("added")).alias("added"),
    )
