"""Text functions, Column to Column.

All but ``seq_ratio`` are Catalyst expressions.  Null in gives null out unless
a function says otherwise.
"""

import unicodedata
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the characters of a token.
WORD_CHARS = r"[a-z0-9_@.+/*:-]+"


def _accent_table() -> tuple[str, str]:
    """Latin letters with marks, and the letter without them."""
    marked, bare = [], []
    for block in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for code in range(*block):
            plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
            if plain != chr(code) and len(plain) == 1:
                marked.append(chr(code))
                bare.append(plain)
    return "".join(marked), "".join(bare)


_MARKED, _BARE = _accent_table()


def strip_accents(text: Column, barred_d: bool = True) -> Column:
    """Letters without their marks; ``barred_d`` also turns the letter d with stroke into d."""
    extra = ("đĐ", "dD") if barred_d else ("", "")
    return F.regexp_replace(F.translate(text, _MARKED + extra[0], _BARE + extra[1]), r"\p{Mn}+", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: Normalisers by name. They are not interchangeable.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    # fold, lower, trim, squeeze
    "common": lambda c: squeeze(_trimmed(F.lower(strip_accents(c)))),
    # delete what isn't a-z, 0-9 or blank, without folding
    "student": lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", "")),
    # fold, delete punctuation, keep white space as it is
    "leak": lambda c: _trimmed(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9\s]", "")),
    # fold, runs of punctuation and space to one blank
    "split": lambda c: F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9]+", " ")),
    # fold, keep punctuation, squeeze
    "bench": lambda c: _trimmed(squeeze(F.lower(strip_accents(c)))),
    # fold, keep the characters of addresses and numbers (a fixed value), others to one blank
    "fresh": lambda c: F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9@.+:/_* -]+", " ")),
    # as common, lower case first
    "t444": lambda c: squeeze(_trimmed(strip_accents(F.lower(c)))),
    # compatibility fold that keeps the barred d
    "kfd": lambda c: strip_accents(c, barred_d=False),
}


def normalize(text: Column, kind: str = "common") -> Column:
    return NORMALIZERS[kind](text)


def tokenize(text: Column, kind: str = "common") -> Column:
    """Tokens of the normalised text."""
    return F.regexp_extract_all(normalize(text, kind), F.lit(WORD_CHARS), F.lit(0))


def phone_digits(text: Column) -> Column:
    """T4."""
    return F.regexp_replace(text, r"\D", "")


#: Words before a name.
HONORIFICS = ("anh", "chị", "chi", "em", "cô", "co", "chú", "chu", "bác", "bac", "ông", "ong", "bà", "ba", "thầy", "thay")


def contact_name(text: Column, honorifics: tuple[str, ...] = HONORIFICS) -> Column:
    """T5: underscores to blanks; a leading word of address goes if a name follows."""
    plain = _trimmed(F.replace(text, F.lit("_"), F.lit(" ")))
    return F.regexp_replace(plain, r"(?i)^(" + "|".join(honorifics) + r")\s+(?=\S)", "")


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams; a shorter text is its own only one.

    A lookahead yields them in one pass; a lambda over positions would evaluate
    ``text`` anew at each.
    """
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.char_length(text) < n, F.array(text)).otherwise(F.array_distinct(found))


def token_set(text: Column) -> Column:
    """Distinct words."""
    return F.array_remove(F.array_distinct(F.split(F.trim(text), r"\s+")), "")


def jaccard(a: Column, b: Column, both_empty: float = 1.0, one_empty: float = 0.0) -> Column:
    """Of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(one_empty))
        .otherwise(both / (F.size(a) + F.size(b) - both))
    )


def seq_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of a to b, in this order; no built-in computes it."""
    import pandas as pd

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def seq_ratio_bound(a: Column, b: Column) -> Column:
    """No ratio of the two can be larger; a lossless filter ahead of ``seq_ratio``."""
    x, y = F.char_length(a), F.char_length(b)
    return F.when(x + y == 0, 1.0).otherwise(2.0 * F.least(x, y) / (x + y))


#: Number words of hours, longest first when matched.
HOUR_WORDS = {
    "khong": 0, "mot": 1, "hai": 2, "ba": 3, "bon": 4, "tu": 4, "nam": 5, "sau": 6, "bay": 7,
    "tam": 8, "chin": 9, "muoi": 10, "muoi mot": 11, "muoi hai": 12,
}


def parse_time(text: Column) -> Column:
    """struct(hour, minute) or null.

    Digits win over number words.  Afternoon and evening words are looked for
    in the text with its accents, for without them one of them is a pronoun.
    """
    plain = normalize(text)
    digits = r"\b(\d{1,2})\s*(?:gio|h)\s*(\d{1,2})?\b"
    has_digits = plain.rlike(digits)
    words = sorted(HOUR_WORDS, key=lambda w: (-len(w), w))
    word = F.regexp_extract(plain, r"\b(" + "|".join(words) + r")\s+(?:gio|h)\b", 1)
    of_word = F.element_at(F.create_map(*[F.lit(x) for pair in HOUR_WORDS.items() for x in pair]), word)
    hour = F.when(has_digits, F.regexp_extract(plain, digits, 1).try_cast("int")).otherwise(of_word)
    minute = F.when(has_digits, F.coalesce(F.regexp_extract(plain, digits, 2).try_cast("int"), F.lit(0))).otherwise(0)
    later = text.rlike(r"(?iu)(?<![\p{L}])(chiều|tối)(?![\p{L}])") & hour.between(1, 11)
    hour = F.when(later, hour + 12).otherwise(hour)
    return F.when(hour.between(0, 23) & minute.between(0, 59), F.struct(hour.cast("int").alias("hour"), minute.cast("int").alias("minute")))


#: T14. What a telephone number, a mail address and a contact URI look like.
PHONE = r"(?<![\p{L}\p{N}_])0[0-9]{8,10}(?![\p{L}\p{N}_])"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-zA-Z]{2,}"
URI = r"content://\S+"


def phones(text: Column) -> Column:
    """T14."""
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def emails(text: Column) -> Column:
    """T14."""
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def uris(text: Column) -> Column:
    """T14."""
    return F.regexp_extract_all(text, F.lit(URI), F.lit(0))


def parse_duration(text: Column) -> Column:
    """struct(amount, unit) of the first duration; unit is hours, minutes or seconds."""
    plain = normalize(text)
    pattern = r"(\d+)\s*(phut|gio|giay)"
    unit = F.element_at(F.create_map(*[F.lit(x) for x in ("phut", "minutes", "gio", "hours", "giay", "seconds")]), F.regexp_extract(plain, pattern, 2))
    return F.when(plain.rlike(pattern), F.struct(F.regexp_extract(plain, pattern, 1).try_cast("bigint").alias("amount"), unit.alias("unit")))


def fill_template(text: Column) -> Column:
    """{word} to word."""
    return F.regexp_replace(text, r"\{(\w+)\}", "$1")


def strict_json(text: Column) -> Column:
    """The text as a variant, null unless it is one JSON value and nothing else.

    The parser overlooks what follows a value, so the text is read inside an
    array and inside an object: what breaks out of one doesn't break out of the
    other.
    """
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(inside) == 1) & named.isNotNull(), F.try_element_at(inside, F.lit(1)))


def extract_json(text: Column) -> Column:
    """The text as JSON, else the widest part in braces, else a rejection.

    A valid value that is no object is returned as it is.
    """
    return F.coalesce(
        strict_json(F.trim(text)),
        strict_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))),
        F.parse_json(F.lit('{"tool":null,"status":"rejected","arguments":{}}')),
    )


def canonical_value(value: Column, mapping: Mapping[str, str]) -> Column:
    """The mapped value of the lower-cased text, else the text itself."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(value)), value)


def label_class(tool: Column, status: Column, null_as: str = "None") -> Column:
    """The tool, or NULL:<status>."""
    return F.coalesce(tool, F.concat(F.lit("NULL:"), F.coalesce(status, F.lit(null_as))))


def canonical_json(entries: Column) -> Column:
    """A map<string, variant> as JSON text with sorted keys."""
    keys = F.array_sort(F.map_keys(entries))
    pairs = F.transform(keys, lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(": "), F.coalesce(F.to_json(F.element_at(entries, k)), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def next_id(ids: Column, prefix: str, width: int = 3) -> Column:
    """Aggregate; one more than the largest number behind the prefix."""
    number = F.regexp_extract(ids, rf"^{prefix}(\d+)$", 1).try_cast("bigint")
    return F.concat(F.lit(prefix), F.lpad((F.coalesce(F.max(number), F.lit(0)) + 1).cast("string"), width, "0"))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def half_even(value: Column, digits: int) -> Column:
    """A double rounded as its exact binary value is, so 2.675 gives 2.67; ties that are exact go to the even digit."""
    import pandas as pd

    @F.pandas_udf(T.DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else round(float(v), digits) for v in x], dtype="float64")

    return rounded(value)


def fixed(value: Column, digits: int) -> Column:
    """A number as text with so many decimals, rounded as ``half_even`` does."""
    return F.format_string(f"%.{digits}f", half_even(value, digits))


def pick(*fields: str, **renamed: str) -> Column:
    """A struct of some fields, those of ``renamed`` by another name."""
    return F.struct(*[F.col(f) for f in fields], *[F.col(old).alias(new) for new, old in renamed.items()])


def route_intent(text: Column, routes: Mapping[str, tuple[str, ...]], default: str = "unknown") -> Column:
    """The first route one of whose keywords the normalised text holds."""
    plain = normalize(text)
    out = None
    for intent, words in routes.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | plain.contains(w)
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.otherwise(default)
