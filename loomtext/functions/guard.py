"""Rules over texts: personal data, prompt injection, refusals, configuration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Patterns of personal data, in the order in which they are applied (fixed values).
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "card": r"\b[0-9]{13,19}\b",
    "phone": r"(\+[0-9]{1,2} ?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}
#: Personal data of the single pass, by priority: the first that fits at a place is taken (fixed values).
ONE_PASS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "credit_card": r"(?<![0-9])(?:[0-9][ \-]?){13,19}(?![0-9])",
    "phone": r"(?:(?:\+|00)[0-9]{1,3}[\s.\-]?)?(?:\([0-9]{1,4}\)[\s.\-]?)?[0-9]{2,4}[\s.\-]?[0-9]{2,4}[\s.\-]?[0-9]{2,4}(?![0-9])",
}
#: What stands in their place (fixed values).
PLACEHOLDERS = {"email": "[REDACTED_EMAIL]", "ssn": "[REDACTED_SSN]", "credit_card": "[REDACTED_CC]", "phone": "[REDACTED_PHONE]"}
#: Signs of prompt injection by label, topics that are refused, and marks of a refusal (fixed values).
INJECTION = {
    "override": r"ignore (all |any )?(previous|prior|above) (instructions|rules)",
    "reveal": r"(reveal|show|print) (the |your )?(system )?prompt",
    "role": r"you are now|act as (an?|the) ",
    "jailbreak": r"jailbreak|developer mode|do anything now",
}
TOPICS = ["weapon", "malware", "self-harm"]
REFUSAL = r"(i cannot|i can't|i am unable|unable to answer|not enough information)"
TOXIC = ["stupid", "idiot", "scum", "trash", "worthless", "clown", "moron", "hate"]


def found(c: Column, kind: str) -> Column:
    """How often a kind of personal data occurs."""
    return F.regexp_count(c, F.lit(PII[kind])).cast("long")


def redacted(c: Column, kinds: list[str] | None = None) -> Column:
    """Each kind in turn replaced by its name in brackets; a later pattern sees what earlier ones left."""
    return reduce(lambda t, k: F.regexp_replace(t, PII[k], f"[{k.upper()}]"), kinds or list(PII), c)


def valid_cards(c: Column) -> Column:
    """Runs of 13 to 19 digits that pass the Luhn check."""
    return F.filter(F.regexp_extract_all(c, F.lit(rf"({PII['card']})"), F.lit(1)), lambda x: F.call_function("luhn_check", x))


def injection_labels(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(c).rlike(p), F.lit(k)) for k, p in INJECTION.items()]))


def input_problems(c: Column, least: int = 3, most: int = 2000) -> Column:
    """Why a question is not taken; empty if it is."""
    length = F.length(F.btrim(c))
    return F.array_compact(
        F.array(
            F.when(length < least, F.lit("short")), F.when(length > most, F.lit("long")),
            *[F.when(F.contains(F.lower(c), F.lit(t)), F.lit(f"topic:{t}")) for t in TOPICS],
            *[F.when(F.lower(c).rlike(p), F.lit(f"injection:{k}")) for k, p in INJECTION.items()],
        )
    )


def toxic_words(c: Column) -> Column:
    """How many of the listed words occur as whole words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    return F.size(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, TOXIC)))).cast("long")


def refuses(c: Column) -> Column:
    return F.lower(c).rlike(REFUSAL)


def problems(rules: dict[str, Column]) -> Column:
    """The names of the rules whose condition holds."""
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))


def one_pass(c: Column) -> Column:
    """array<struct<kind, value, keep>> of personal data, found in one pass from left to right without overlaps; keep: a run of
    digits in the form of a card that fails the Luhn check, which is no card and stays."""
    pattern = "|".join(f"({p})" for p in ONE_PASS.values())
    groups = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in range(len(ONE_PASS) + 1)]
    kinds = list(ONE_PASS)

    def of(x: Column) -> Column:
        kind = F.coalesce(*[F.when(x[str(i + 1)] != "", F.lit(k)) for i, k in enumerate(kinds)])
        digits = F.regexp_replace(x["0"], "[^0-9]", "")
        return F.struct(kind.alias("kind"), x["0"].alias("value"), ((kind == "credit_card") & ~F.call_function("luhn_check", digits)).alias("keep"))

    return F.transform(F.arrays_zip(*[g.alias(str(i)) for i, g in enumerate(groups)]), of)


def one_pass_redacted(c: Column, found: Column) -> Column:
    """The text with what one_pass() found replaced: the pieces between, and placeholders."""
    pieces = F.split(c, "|".join(f"(?:{p})" for p in ONE_PASS.values()), -1)
    place = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    marks = F.transform(found, lambda x: F.when(x["keep"], x["value"]).otherwise(place[x["kind"]]))
    return F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit("")))), "")


_SPAN = StructType().add("kind", StringType()).add("value", StringType()).add("start", IntegerType()).add("end", IntegerType())


@F.pandas_udf(ArrayType(_SPAN))
def pii_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Kind, value and place of what the single pass finds; built-in functions give no places."""
    pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in ONE_PASS.items()))

    def is_card(value: str) -> bool:
        digits = [int(x) for x in value if x.isdigit()][::-1]
        return (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0

    def of(text: str | None) -> list[dict]:
        hits = pattern.finditer(text or "")
        return [{"kind": m.lastgroup, "value": m[0], "start": m.start(), "end": m.end()} for m in hits if m.lastgroup != "credit_card" or is_card(m[0])]

    for texts in batches:
        yield texts.map(of)


def counted_redaction(c: Column) -> tuple[Column, dict[str, Column]]:
    """redacted(), and how often each kind was replaced in what earlier ones had left."""
    counts = {}
    for k, p in PII.items():
        counts[k] = F.regexp_count(c, F.lit(p)).cast("long")
        c = F.regexp_replace(c, p, f"[{k.upper()}]")
    return c, counts
