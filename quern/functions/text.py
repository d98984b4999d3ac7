"""Text functions on columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", "")


def normalize(c: Column) -> Column:
    return squeeze(F.lower(c))


def word_count(c: Column) -> Column:
    """Words with apostrophes and hyphens, in any script."""
    return F.regexp_count(c, F.lit(r"(?U)\b[\w'-]+\b"))


def words(c: Column) -> Column:
    """Pieces between white space; none for blank text."""
    s = squeeze(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(words(c)) * 1.3)).cast("bigint")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def ngram_set(tokens_: Column, n: int) -> Column:
    """Distinct n-grams of a token array, joined by blanks; none when it is shorter than n."""
    # by element: slice copies the whole array each time, which is quadratic in a text's length
    made = F.transform(F.sequence(F.lit(0), F.size(tokens_) - n), lambda i: F.concat_ws(" ", *(F.get(tokens_, i + k) for k in range(n))))
    return F.when(F.size(tokens_) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), r"(?<=[!.?])\s+"), strip), lambda s: s != "")


def found_in(lexicon: list[str], normal: Column) -> Column:
    """Phrases of a lexicon that occur in normalised text, in the lexicon's order."""
    return F.filter(F.array(*map(F.lit, lexicon)), lambda p: F.contains(normal, p))


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def render(subject: Column, body: Column) -> Column:
    return strip(F.concat(F.lit("Subject: "), strip(subject), F.lit("\nBody: "), strip(body)))


def parse_rendered(text: Column) -> Column:
    """Struct (subject, body) of text that ``render`` made; any other text is all body."""
    head = F.substring_index(text, "\nBody:", 1)
    split = F.contains(text, F.lit("\nBody:")) & F.startswith(F.lower(head), F.lit("subject:"))
    rest = F.substring(text, F.length(head) + 7, 2147483647)
    return F.struct(
        F.when(split, strip(F.substring(head, 9, 2147483647))).otherwise(F.lit("")).alias("subject"),
        F.when(split, strip(rest)).otherwise(strip(text)).alias("body"),
    )


def parse_labelled(text: Column) -> Column:
    """Struct (subject, body): the first non-empty 'subject:' line, and what follows the first 'body:'."""
    at = F.instr(F.lower(text), "body:")
    return F.struct(
        strip(F.regexp_extract(text, r"(?im)^subject:[^\S\n]*(\S[^\n]*)", 1)).alias("subject"),
        F.when(at > 0, strip(F.substring(text, at + 5, F.lit(2147483647)))).otherwise(strip(text)).alias("body"),
    )


def whole_json(c: Column) -> Column:
    """The text as a variant if all of it is one JSON value, else null. The parser alone would stop after the first value."""
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))


def parse_output(c: Column) -> Column:
    """Struct (subject, body) of a string column: the fields of a JSON object; blanks for other JSON; else the text as body."""
    v = whole_json(c)
    kind = F.schema_of_variant(v)
    is_object = F.startswith(kind, F.lit("OBJECT"))
    field = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    return F.struct(
        F.when(is_object, field("subject")).otherwise(F.lit("")).alias("subject"),
        F.when(is_object, field("body")).when(v.isNotNull() | c.isNull(), F.lit("")).otherwise(c).alias("body"),
    )


def parse_candidate(c: Column) -> Column:
    """Struct (subject, body) of a string column: an object's fields, or those of its candidate_output; else as ``parse_rendered``."""
    v = whole_json(c)
    get = lambda path: F.try_variant_get(v, path, "string")
    top, inner = get("$.subject").isNotNull() & get("$.body").isNotNull(), F.try_variant_get(v, "$.candidate_output", "variant").isNotNull()
    field = lambda k: F.when(top, get(f"$.{k}")).when(inner, F.coalesce(get(f"$.candidate_output.{k}"), F.lit("")))
    said = parse_rendered(c)
    return F.struct(*(F.when(top | inner, field(k)).when(v.isNotNull() | c.isNull(), F.lit("")).otherwise(said[k]).alias(k) for k in ("subject", "body")))


def sha_number(c: Column) -> Column:
    """The first 8 hexadecimal digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint")
