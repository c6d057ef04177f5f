"""Column expressions over text, arrays and maps. No UDFs: every function stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import fixed
from parley.settings import DEFAULTS

# Unicode white space, spelled out so that Java and other engines agree on it.
SPACE = (r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
         r"\x{3000}]")
ENTRY = "array<struct<key:string,value:string>>"


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(toks: Column) -> Column:
    """Tokens longer than one character that are not stop words."""
    stop = words(fixed.STOP_WORDS)
    return F.filter(toks, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def digest(text: Column) -> Column:
    """16-byte key of a text: what rows of one text carry through shuffles in its place."""
    return F.unhex(F.md5(text.cast("binary")))


def phrase_of(toks: Column) -> Column:
    return F.array_join(toks, " ")


def padded(toks: Column) -> Column:
    """Token blob: one space between tokens and around the whole."""
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


def covers(blob: Column, phrase: Column) -> Column:
    """Contiguous-token containment on a padded blob."""
    return F.contains(blob, F.concat(F.lit(" "), phrase, F.lit(" ")))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def clean_value(text: Column, limit: int = DEFAULTS.value_chars) -> Column:
    """Collapse white space, trim separators, cut, trim the right end."""
    return F.rtrim(F.substring(F.btrim(collapse(text), F.lit(" -;,.")), 1, limit))


def entries(col: Column, dtype: T.DataType) -> Column:
    """Any catalogue text field as a list of (key, value); list and scalar values have no key."""
    none = F.expr(f"cast(array() as {ENTRY})")
    text = F.lit(None).cast("string")
    if isinstance(dtype, T.MapType):
        out = F.transform(F.map_entries(col), lambda e: F.struct(
            e["key"].cast("string").alias("key"), e["value"].cast("string").alias("value")))
    elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        out = col
    elif isinstance(dtype, T.ArrayType):
        out = F.transform(col, lambda v: F.struct(text.alias("key"), v.cast("string").alias("value")))
    else:
        out = F.when(col.isNotNull(), F.array(
            F.struct(text.alias("key"), col.cast("string").alias("value"))))
    return F.coalesce(out.cast(ENTRY), none)


def variant_entries(v: Column) -> Column:
    """The same list for a dynamic JSON value: object, list, scalar or null."""
    text = F.lit(None).cast("string")
    as_map = F.try_variant_get(v, "$", "map<string,variant>")
    as_list = F.try_variant_get(v, "$", "array<variant>")
    scalar = F.try_variant_get(v, "$", "string")

    def render(x):
        return F.when(~F.is_variant_null(x), F.coalesce(
            F.try_variant_get(x, "$", "string"), F.to_json(x)))

    return F.coalesce(
        F.transform(F.map_entries(as_map), lambda e: F.struct(
            e["key"].alias("key"), render(e["value"]).alias("value"))).cast(ENTRY),
        F.transform(as_list, lambda x: F.struct(text.alias("key"), render(x).alias("value"))).cast(ENTRY),
        F.when(scalar.isNotNull(), F.array(F.struct(text.alias("key"), scalar.alias("value")))).cast(ENTRY),
        F.expr(f"cast(array() as {ENTRY})"))


def flatten_text(ents: Column) -> Column:
    """One string: "value" or "key value", joined by a space. A null inside a list reads None."""
    return F.array_join(F.transform(ents, lambda e: F.concat_ws(
        " ", e["key"], F.coalesce(e["value"], F.lit("None")))), " ")


def flatten_values(ents: Column) -> Column:
    """List of "value" or "key: value"; null and empty values (and empty lists in maps) are skipped."""
    kept = F.filter(ents, lambda e: e["value"].isNotNull() & (e["value"] != "")
                    & ~(e["key"].isNotNull() & (e["value"] == "[]")))
    return F.transform(kept, lambda e: F.concat_ws(": ", e["key"], e["value"]))


def first_word(text: Column, vocabulary) -> Column:
    """First whole word of the vocabulary in the text, lower-cased; null when there is none."""
    pattern = r"(?i)\b(" + "|".join(vocabulary) + r")\b"
    return F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit(""))


def family(value: Column) -> Column:
    """Constraint family of a value: ordered substring tests."""
    low = F.lower(value)
    out = F.when(F.contains(low, F.lit(fixed.BUDGET_WORD)) | low.rlike(fixed.BUDGET_PATTERN), "budget")
    for name, cues in fixed.FAMILY_WORDS:
        # an alternation of plain words is a substring test compiled once per task
        out = out.when(low.rlike("|".join(cues)), name)
    return out.otherwise(fixed.DEFAULT_FAMILY)


def coarse_category(categories: Column) -> Column:
    """Last two category parts after splitting at commas and dropping the generic names."""
    parts = F.flatten(F.transform(categories, lambda c: F.split(c, ",")))
    parts = F.transform(parts, lambda p: F.btrim(p))
    generic = words(fixed.GENERIC_CATEGORIES)
    kept = F.filter(parts, lambda p: (p != "") & ~F.array_contains(generic, F.lower(p)))
    return F.when(F.size(kept) > 0, F.array_join(
        F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), F.lit(2)), " ")
    ).otherwise(fixed.DEFAULT_CATEGORY)


def popularity(rating_number: Column) -> Column:
    """log1p of the review count; anything unusable counts as 0."""
    n = F.coalesce(rating_number.cast("string").try_cast("double"), F.lit(0.0))
    return F.log1p(F.greatest(n, F.lit(0.0)))


def normalise_proposal(text: Column, strip_chars: str = ".") -> Column:
    """Lower-case, single spaces, punctuation trimmed at both ends."""
    return F.btrim(F.btrim(collapse(F.lower(text))), F.lit(strip_chars))


def pick(choices, byte: Column) -> Column:
    """Element of a fixed list chosen by a byte value."""
    return F.try_element_at(words(choices), (F.pmod(byte, F.lit(len(choices))) + 1).cast("int"))


def question_text(attribute: Column, narrow: Column, seed: Column, variety: bool = True) -> Column:
    """Customer-facing sentence; slots are chosen by the first three bytes of a SHA-256."""
    question = F.lit(None).cast("array<string>")
    for name, forms in fixed.QUESTIONS.items():
        question = F.when(attribute == name, words(forms)).otherwise(question)
    question = F.coalesce(question, words(fixed.QUESTION_DEFAULT))
    if not variety:
        opener = F.when(narrow, F.lit(fixed.OPENERS_NARROW[0])).otherwise(fixed.OPENERS_WIDE[0])
        return F.concat(opener, F.lit(" "), question[0], F.lit("?"))
    digest = F.sha2(F.concat_ws("|", seed, attribute,
                                F.when(narrow, F.lit("True")).otherwise("False")), 256)

    def byte(i):
        return F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")

    opener = F.when(narrow, pick(fixed.OPENERS_NARROW, byte(0))).otherwise(
        pick(fixed.OPENERS_WIDE, byte(0)))
    asked = F.try_element_at(question, (F.pmod(byte(1), F.size(question)) + 1).cast("int"))
    return F.concat(opener, F.lit(" "), asked, pick(fixed.CLOSERS, byte(2)))


def first_tokens(phrase: Column, n: Column) -> Column:
    """First n tokens of a space-joined phrase, n varying by row."""
    return F.call_function("substring_index", phrase, F.lit(" "), n)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]
