"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) are found by their patterns and checks and always stay. Around them the method
looks at wider candidates: base matches that failed their check, and shapes without a fixed rule (national phone numbers,
social security numbers, bank accounts, spelled-out addresses, persons). Four labelers vote on every candidate:

* ``shape``: the strict rule of its kind (+1 or -1);
* ``gazetteer``: given names, mail providers, country codes (+1, else silent);
* ``context``: words shortly before it, speaking for the kind (+1) or for a plain number (-1);
* ``border``: glued to letters, digits or signs of a longer token (-1, else silent).

Vote patterns are counted over the whole table; there are at most a few hundred. Expectation-maximisation over these
counts estimates how reliable each labeler is and gives every pattern a posterior. A logistic span classifier over
kind, votes, length and share of digits is then trained on all candidates with the posteriors as soft labels.
Candidates of the added kinds that it accepts, that pass the strict rule of their kind, and that overlap no base span,
become further spans; added spans of different kinds may overlap. Failed base matches take part in the training only.

Spans are in code points, end exclusive. Patterns are written with possessive repetition and anchors at the start of
a run, so that very long runs take linear time; n matches of a text take n log n. Spelled-out addresses are found with up to
64 and 63 characters a part, persons with names of up to 31 letters. Null texts are empty and have no spans; null ids and repeated rows
give one result row each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import ids_and_texts
from flowloom.session import materialize

# (?:\G|(?<!c)): the start of a run of c, or the place where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+)(.-])(?<![0-9)] )(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])",
    "social_security": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "bank_account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}+(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+"
                     r"(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}+)++",
    "person": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Monsieur|Señor|Señora)\.? \p{Lu}\p{Ll}{1,30}+"
              r"(?: \p{Lu}\p{Ll}{1,30}+)?(?![\p{L}])",
}
# A cheap test that every match passes, to leave most texts alone.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{10}", "phone": r"\+[0-9]",
         "local_phone": r"[0-9][-.][0-9]{4}", "social_security": "[0-9]-[0-9]{2}-[0-9]",
         "bank_account": "[A-Z]{2}[0-9]{2}", "spelled_email": r"at[\])]", "person": r"[rseau]\.? \p{Lu}"}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)

# What the gazetteer and the context labeler know.
GIVEN_NAMES = ("Anna", "Anne", "Carlos", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "José", "Juan",
               "Julia", "Karl", "Laura", "Maria", "María", "Marie", "Mary", "Michael", "Paul", "Peter", "Pierre",
               "Robert", "Sarah", "Thomas")
PROVIDERS = ("gmail", "googlemail", "gmx", "hotmail", "icloud", "outlook", "proton", "protonmail", "yahoo")
COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CUES = {
    "email": "e-?mail|contact|write to|correo|courriel", "ip": "ip|host|server|address|addr",
    "card": "card|visa|credit|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobile|cell",
    "local_phone": "phone|tel|call|fax|mobile|cell", "social_security": "ssn|social security",
    "bank_account": "iban|account|konto|compte|cuenta", "spelled_email": "e-?mail|contact|write to|correo|courriel",
    "person": "name|from|by|dear|contact|signed",
}
COUNTER_CUES = "version|order|invoice|ratio|isbn|page|figure|table|chapter|serial|build|release"
CONTEXT, PIECE = 32, 4096
CODES = {"shape": (-1, 1), "gazetteer": (0, 1), "context": (-1, 0, 1), "border": (-1, 0)}
EM_ROUNDS, SMOOTHING = 60, 0.5
ACCEPT = 0.5


# --- arrays -----------------------------------------------------------------------------

def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals by an associative ``combine``: each step doubles the reach, so n values take n log n."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def reach(done: Column, step: Column) -> Column:
        shift = F.pow(F.lit(2), step).cast("int")
        return F.transform(done, lambda x, i: F.when(i >= shift, combine(x, F.get(done, i - shift))).otherwise(x))

    return F.aggregate(steps, values, reach)


# --- spans ------------------------------------------------------------------------------

def located(text: Column, kind: str) -> Column:
    """start, end and match of all leftmost non-overlapping matches. Cutting the text at the pattern gives the gaps
    between the matches; gaps and matches give the places."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)

    def spans(cut: Column) -> Column:
        steps = F.zip_with(F.slice(cut["gaps"], F.lit(1), F.size(cut["matches"])), cut["matches"],
                           lambda g, m: F.char_length(g) + F.char_length(m))
        return F.zip_with(running(steps, lambda x, y: x + y), cut["matches"], lambda end, m: F.struct(
            (end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("match")))

    found = bound(F.struct(gaps.alias("gaps"), matches.alias("matches")), spans)
    return F.when(text.rlike(HINTS[kind]), found).otherwise(
        F.array().cast("array<struct<start:int,end:int,match:string>>"))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def strict(kind: str, match: Column) -> Column:
    """The check of a kind beyond its pattern."""
    n = F.length(digits_of(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits_of(match))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "local_phone":
        return match.rlike(r"^\(?[2-9]")
    if kind == "social_security":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "bank_account":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34)
    return F.lit(True)


def gazetteer(kind: str, match: Column) -> Column:
    if kind in ("email", "spelled_email"):
        return match.rlike(rf"(?i)[@)\] ](?:{'|'.join(PROVIDERS)})\b")
    if kind == "bank_account":
        return match.rlike(f"^(?:{'|'.join(COUNTRIES)})")
    if kind == "person":
        return match.rlike(rf"(?<!\p{{L}})(?:{'|'.join(GIVEN_NAMES)})(?!\p{{L}})")
    if kind == "phone":
        return match.rlike(r"^\+(?:1|33|34|39|4[1-9])[^0-9]?")
    return F.lit(False)


def votes(text: Column, kind: str, spans: Column) -> Column:
    """Spans with the four votes. What surrounds a span is read from pieces of ``PIECE`` characters, not from the start of
    the text."""
    def of(span: Column, pieces: Column) -> Column:
        first = F.greatest(F.lit(0), span["start"] - CONTEXT)
        piece = F.floor(first / PIECE).cast("int")
        two = F.concat(F.get(pieces, piece), F.coalesce(F.get(pieces, piece + 1), F.lit("")))
        before = F.substring(two, first - piece * PIECE + 1, span["start"] - first)
        after = F.substring(F.coalesce(F.get(pieces, F.floor(span["end"] / PIECE).cast("int")), F.lit("")),
                            span["end"] % PIECE + 1, F.lit(1))
        around = F.concat(F.substring(before, -1, 1), F.lit("\n"), after)
        context = (F.when(before.rlike(rf"(?i)\b(?:{CUES[kind]})\b"), 1)
                   .when(before.rlike(rf"(?i)\b(?:{COUNTER_CUES})\b"), -1).otherwise(0))
        return F.struct(
            F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
            F.when(strict(kind, span["match"]), 1).otherwise(-1).alias("shape"),
            F.when(gazetteer(kind, span["match"]), 1).otherwise(0).alias("gazetteer"), context.alias("context"),
            F.when(around.rlike(r"[\p{L}\p{N}_/=]"), -1).otherwise(0).alias("border"),
            F.least(F.lit(5), F.floor((span["end"] - span["start"]) / 8)).cast("int").alias("size"),
            F.round(F.length(digits_of(span["match"])) / (span["end"] - span["start"]), 1).alias("digits"))

    def all_of(found: Column) -> Column:
        pieces = F.when(F.size(found) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
        return bound(pieces, lambda cut: F.transform(found, lambda span: of(span, cut)))

    return bound(spans, all_of)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidates in the order of kinds, then places."""
    texts = ids_and_texts(docs)
    text = F.col("text")
    found = F.concat(*[votes(text, kind, located(text, kind)) for kind in KINDS])
    return texts.select("doc_id", found.alias("found"))


# --- weak supervision ---------------------------------------------------------------------

def reliabilities(patterns: list[tuple[tuple[int, ...], float]]) -> dict[tuple[int, ...], float]:
    """Posterior of "personal" per vote pattern by expectation-maximisation over (votes, count).

    Labelers are taken to err independently. The start trusts the sum of the votes.
    """
    names = list(CODES)
    posterior = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in patterns}
    for _ in range(EM_ROUNDS):
        prior = [SMOOTHING, SMOOTHING]
        table = [[dict.fromkeys(CODES[name], SMOOTHING) for name in names] for _ in (0, 1)]
        for v, n in patterns:
            for y, p in ((1, posterior[v]), (0, 1 - posterior[v])):
                prior[y] += n * p
                for i, code in enumerate(v):
                    table[y][i][code] += n * p

        def log_likelihood(y: int, v: tuple[int, ...]) -> float:
            return math.log(prior[y]) + sum(math.log(table[y][i][c] / sum(table[y][i].values()))
                                            for i, c in enumerate(v))

        posterior = {v: 1 / (1 + math.exp(min(500.0, log_likelihood(0, v) - log_likelihood(1, v))))
                     for v, _ in patterns}
    return posterior


def features(span: Column) -> list[Column]:
    """Numbers the classifier sees."""
    return [*[(span["kind"] == kind).cast("double") for kind in KINDS],
            *[span[name].cast("double") for name in CODES], span["size"].cast("double"), span["digits"]]


def train_classifier(found: DataFrame) -> tuple[list[float], float]:
    """Weights and offset of the span classifier, from all candidates; nothing is accepted where there are none."""
    counted = materialize(found.select(F.explode("found").alias("span"))
                          .groupBy("span.kind", *[f"span.{c}" for c in CODES], "span.size", "span.digits")
                          .agg(F.count(F.lit(1)).alias("n")), "span-patterns")
    # At most 2 * 2 * 3 * 2 rows.
    patterns = [(tuple(r[c] for c in CODES), float(r["n"]))
                for r in counted.groupBy(*CODES).agg(F.sum("n").alias("n")).collect()]
    width = len(KINDS) + len(CODES) + 2
    if not patterns:
        return [0.0] * width, -1.0
    posterior = reliabilities(patterns)
    key = F.concat_ws(",", *[F.col(c).cast("string") for c in CODES])
    entries = [F.lit(x) for v, p in posterior.items() for x in (",".join(map(str, v)), p)]
    soft = counted.withColumn("p", F.element_at(F.create_map(*entries), key))
    span = F.struct("kind", *CODES, "size", "digits")
    rows = soft.select(array_to_vector(F.array(*features(span))).alias("features"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("y"))
    rows = materialize(rows.select("features", "y.label", "y.weight").filter("weight > 0"), "span-examples")
    if rows.select("label").distinct().count() < 2:
        return [0.0] * width, 1.0 if rows.filter("label = 1").count() else -1.0
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50).fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept)


def find_private(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base (spans), added (spans with their probability)."""
    found = materialize(candidates(docs), "candidates")
    weights, offset = train_classifier(found)

    def probability(span: Column) -> Column:
        total = F.lit(offset)
        for w, x in zip(weights, features(span), strict=True):
            total = total + F.lit(w) * x
        return 1 / (1 + F.exp(-total))

    is_base = lambda s: s["kind"].isin(*BASE_KINDS)
    base = F.filter("found", lambda s: is_base(s) & (s["shape"] == 1))
    rows = found.select("doc_id", "found", base.alias("base"))
    scored = F.transform(F.filter("found", lambda s: ~is_base(s)), lambda s: s.withField("probability", probability(s)))
    accepted = F.filter(scored, lambda s: (s["probability"] >= ACCEPT) & (s["shape"] == 1))
    return rows.select("doc_id", "base", apart(accepted, F.col("base")).alias("added"))


def apart(spans: Column, others: Column) -> Column:
    """``spans``, in their order, that overlap none of ``others``.

    Of all others that start before a span ends, the farthest end tells. So both are sorted by place, the others by their
    start and the spans by their last character, and the farthest end so far is a running maximum.
    """
    nothing = F.lit(None)
    opened = F.transform(others, lambda o: F.struct(
        o["start"].alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("place"), o["end"].alias("end")))
    asked = F.transform(spans, lambda s, i: F.struct(
        (s["end"] - 1).alias("at"), F.lit(1).alias("kind"), i.alias("place"), nothing.cast("int").alias("end")))

    def free(events: Column) -> Column:
        far = running(F.transform(events, lambda e: F.coalesce(e["end"], F.lit(0))), lambda x, y: F.greatest(x, y))
        ends = F.filter(F.zip_with(events, far, lambda e, f: F.struct(e["kind"].alias("kind"), e["place"].alias("place"),
                                                                      f.alias("far"))), lambda e: e["kind"] == 1)
        by_place = F.transform(F.array_sort(F.transform(ends, lambda e: F.struct(e["place"], e["far"]))),
                               lambda e: e["far"])
        return bound(by_place, lambda far: F.filter(spans, lambda s, i: F.get(far, i) <= s["start"]))

    return bound(F.array_sort(F.concat(opened, asked)), free)


def span_texts(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")

