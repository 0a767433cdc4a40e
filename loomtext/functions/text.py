"""Column functions over text: tokens, sentences, n-grams, ids, estimates. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic (fixed values).
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were what when which who will with".split()


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value of c. Spark makes an expression that stands inside another's lambda anew for each element; a value that is
    bound here is made once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-case text."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def tokens_with_marks(c: Column | str) -> Column:
    """Tokens that keep inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("([a-z0-9][a-z0-9'\\-]*)"), F.lit(1))


def split_words(c: Column | str, lower: bool = True) -> Column:
    """What stands between white space."""
    return F.filter(F.split(F.lower(_c(c)) if lower else _c(c), r"\s+"), lambda x: x != "")


def key_terms(c: Column | str) -> Column:
    """Distinct tokens in order of appearance, without stop words."""
    return F.array_distinct(F.filter(tokens_with_marks(c), lambda x: ~x.isin(STOPWORDS)))


def sentences(c: Column | str) -> Column:
    """Split at white space after a full stop, question mark or exclamation mark."""
    return F.filter(F.split(_c(c), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def facts(c: Column | str) -> Column:
    """Sentences cut again at semicolons and commas, without the marks around them."""
    parts = F.flatten(F.transform(sentences(c), lambda s: F.split(s, "[;,]")))
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" .;:"))), lambda x: x != "")


def ngrams(words: Column, n: int = 3) -> Column:
    """Consecutive words, joined by blanks; none if there are fewer than n."""

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - n + 1)
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def normalized(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_c(c)), r"\s+", " "))


def snippet(c: Column | str, n: int = 90) -> Column:
    flat = F.btrim(F.regexp_replace(_c(c), r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def estimated_tokens(c: Column | str) -> Column:
    """A token for each four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(c)) / 4)).cast("long")


def content_id(source: Column, index: Column, c: Column) -> Column:
    """sha1 of source, number and the first 80 characters."""
    return F.sha1(F.concat_ws(":", source, index.cast("string"), F.substring(c, 1, 80)).cast("binary"))


def place_id(source: Column, index: Column) -> Column:
    """The first 16 digits of the md5 of source and number."""
    return F.substring(F.md5(F.concat(source, F.lit("::"), index.cast("string")).cast("binary")), 1, 16)


def citations(c: Column | str) -> Column:
    """Numbers in square brackets, in order."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def hash_bucket(token: Column, dims: int) -> Column:
    """A stable bucket: the first eight hexadecimal digits of the md5, modulo dims."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dims).cast("int")


def token_share(of: Column, within: Column) -> Column:
    """Share of the distinct tokens `of` that are also in `within`; null if there are none."""
    distinct = F.array_distinct(of)
    return F.try_divide(F.size(F.array_intersect(distinct, within)).cast("double"), F.size(distinct).cast("double"))


def content_tokens(c: Column | str) -> Column:
    """Distinct tokens without stop words."""
    return F.array_except(tokens(c), F.array(*map(F.lit, STOPWORDS)))


def opened_sentences(c: Column | str) -> Column:
    """Split at white space after a mark that ends a sentence where a capital, a figure, a quote or a bracket follows."""
    return F.filter(F.split(F.btrim(_c(c), F.lit(" \t\n\r")), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"), lambda x: F.trim(x) != "")


def sentence_starts(c: Column | str, chars: int = 40, least: int = 8) -> Column:
    """The distinct first characters of sentences of at least `least` characters."""
    return F.array_distinct(F.transform(F.filter(sentences(c), lambda x: F.length(x) >= least), lambda x: F.substring(x, 1, chars)))


def unfenced(c: Column | str) -> Column:
    """What stands inside a Markdown code fence around the whole text; else the text."""
    inside = F.regexp_extract(F.btrim(_c(c)), r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inside != "", inside).otherwise(F.btrim(_c(c)))


def json_inside(c: Column | str) -> Column:
    """The outermost object, or else the outermost list, in a noisy text; null if there is neither."""
    text = unfenced(c)
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    found = F.when(found != "", found).otherwise(F.regexp_extract(text, r"(?s)\[.*\]", 0))
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def judged(c: Column | str, key: str) -> Column:
    """A score from 1 to 5 in the JSON of a judge's reply, rounded half to even; null for anything else, true and false too."""
    raw = F.get_json_object(json_inside(c), f"$.{key}")
    number = raw.try_cast("double")
    return F.when(number.between(1, 5), F.bround(number)).cast("int")


def verdict(c: Column | str, key: str) -> Column:
    """Whether a line `KEY: ...` of a reply says PASS; null without such a line."""
    line = F.regexp_extract(F.upper(_c(c)), rf"(?m)^\s*{key.upper()}\s*:(.*)$", 1)
    return F.when(F.btrim(line) != "", F.contains(line, F.lit("PASS")))


def sanitized(c: Column | str, sources: int) -> Column:
    """Without marks [n] of sources that there aren't, 1 to `sources` being there."""
    valid = "|".join(map(str, range(1, sources + 1)))
    return F.btrim(F.regexp_replace(_c(c), rf"\[(?!0*(?:{valid})\])[0-9]+\]", ""))


def without_label(c: Column | str, labels: list[str]) -> Column:
    """Without a leading `label:`, in any case."""
    return F.btrim(F.regexp_replace(_c(c), rf"(?i)^\s*(?:{'|'.join(labels)})\s*:\s*", ""))


def listed(items: Column, each: int = 220, total: int = 3000) -> Column:
    """Items cut to `each` characters, one a line, cut to `total`."""
    return F.substring(F.array_join(F.transform(items, lambda x: F.substring(x, 1, each)), "\n"), 1, total)


def buckets(c: Column | str, dims: int = 256) -> Column:
    """The hashed tokens of a text, a stand-in for a model's vector."""
    return F.transform(tokens(c), lambda t: hash_bucket(t, dims))


def bag_cosine(a: Column, b: Column, dims: int = 256) -> Column:
    """Cosine of the counts of two lists of bucket numbers below dims; 0 if either is empty. Short lists are compared element by
    element, long ones by their counts, so that a pair takes at most dims steps for each element."""

    def counts(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(x, lambda j: j == d)).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        n, m = F.size(x).cast("double"), F.size(y).cast("double")
        each = F.aggregate(F.transform(x, lambda i: F.size(F.filter(y, lambda j: j == i))), F.lit(0), lambda s, k: s + k).cast("double")
        whole = F.aggregate(F.zip_with(counts(x), counts(y), lambda p, q: p * q), F.lit(0.0), lambda s, k: s + k)
        return F.when(n * m <= dims * (n + m), each).otherwise(whole)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))
