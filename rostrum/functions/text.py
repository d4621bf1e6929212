"""Text functions as Columns; Python only where Spark has no equivalent (Unicode decomposition)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes of the measures.
LETTERS = r"\p{L}+"
VOWELS = r"(?iu)[aeiouyàáâäèéêëìíîïòóôöùúûü]+"


def normalize(text: Column) -> Column:
    """Lower case, every other run of characters than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LETTERS), F.lit(0))


def text_stats(text: Column) -> dict[str, Column]:
    """Counts of words, sentences, syllables, long words (over 6 letters) and distinct words.

    A word has as many syllables as runs of vowels, at least one; a sentence is a piece with a letter between
    sentence marks before white space.  Each count is one regular expression over the text, so that
    no array of words is built but for the distinct ones.
    """
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    vowelless = r"(?<!\p{L})(?:(?!%s)\p{L})++(?!\p{L})" % VOWELS
    n = count(LETTERS)
    # Marks are taken from their first one on and not given back: a run of dots is read once.
    sentences = count(r"(?s)\p{L}.*?(?:(?<![.!?])[.!?]++(?:\s|\z)|\z)")
    return {
        "word_count": n,
        "sentence_count": sentences,
        "syllable_count": count(VOWELS) + count(vowelless),
        "long_word_count": count(r"\p{L}{7,}"),
        "unique_word_count": F.size(F.array_distinct(F.transform(F.array_distinct(words(text)), F.lower))),
    }


# Coefficients of the readability measures.


def flesch_douma(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """206.84 - 0.93 words per sentence - 77 syllables per word; 0 without words or sentences."""
    ok = (n_words > 0) & (n_sentences > 0)
    return F.when(ok, 206.84 - 0.93 * F.try_divide(n_words, n_sentences) - 77 * F.try_divide(n_syllables, n_words)).otherwise(0.0)


def lix(n_words: Column, n_sentences: Column, n_long: Column) -> Column:
    """Words per sentence plus percentage of long words."""
    ok = (n_words > 0) & (n_sentences > 0)
    return F.when(ok, F.try_divide(n_words, n_sentences) + F.try_divide(100 * n_long, n_words)).otherwise(0.0)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part``; 0 for an empty one."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (gone / F.length(part)).cast("int")).otherwise(0)


def classify_fragment(fragment: Column, text: Column) -> Column:
    """none, valid, valid_multipart, not_found or ambiguous: whether a quoted fragment points to one place.

    A fragment with ellipses matches as its parts in order, with anything between them; several
    readings of that are ambiguous.
    """
    n = occurrences(text, fragment)
    parts = F.filter(F.transform(F.split(fragment, r"\s*(?:\.\.\.|…)\s*"), lambda x: F.trim(x)), lambda p: p != "")
    quoted = F.transform(parts, lambda p: F.regexp_replace(p, r"([\\\[\](){}.*+?^$|])", r"\\$1"))
    m = F.regexp_count(text, F.concat(F.lit("(?s)"), F.array_join(quoted, ".*?")))
    many = F.size(parts) > 1
    single = F.when(n == 1, "valid").when(n > 1, "ambiguous").otherwise("not_found")
    multi = F.when(m == 1, "valid_multipart").when(m > 1, "ambiguous").otherwise("not_found")
    return F.when(fragment.isNull() | (F.trim(fragment) == ""), "none").when(n > 0, single).when(many, multi).otherwise("not_found")


def fragment_span(text: Column, pattern: Column) -> Column:
    """struct(start, end) of the first match of a pattern, offsets from 0; null without one."""
    hit = F.coalesce(F.regexp_substr(text, pattern), F.lit(""))
    at = F.instr(text, hit).cast("long") - 1
    return F.when(hit != "", F.struct(at.alias("start"), (at + F.length(hit)).alias("end")))


def strip_speaker(text: Column, surname: Column, chair: str = "De voorzitter") -> Column:
    """Without the speaker's name before the first colon (chair literal, else the surname within 60 characters)."""
    at = F.locate(":", text)
    head = F.left(text, at - 1)
    named = text.startswith(chair + ":") | ((at > 0) & (at <= 61) & F.contains(F.lower(head), F.lower(surname)))
    return F.when(F.coalesce(named, F.lit(False)), F.ltrim(F.substr(text, at + 1))).otherwise(text)


def opening_needle(text: Column, n: int = 10, least: int = 4) -> Column:
    """First ``n`` normalised words after a leading ``Name:``; null with fewer than ``least``."""
    w = F.filter(F.split(normalize(F.regexp_replace(text, r"^[^:\n]{1,80}:\s*", "")), " "), lambda x: x != "")
    return F.when(F.size(w) >= least, F.array_join(F.slice(w, 1, n), " "))


def context_window(text: Column, start: Column, end: Column, radius: int = 200) -> Column:
    """Text around [start, end) with ellipses where it is cut; offsets from 0."""
    a, z = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(text))
    return F.concat(F.when(a > 0, "…").otherwise(""), F.substr(text, a + 1, z - a), F.when(z < F.length(text), "…").otherwise(""))


def speaking_seconds(text: Column) -> Column:
    """Estimated speaking time: 2.4 words a second, at least one second."""
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    return F.greatest(n / 2.4, F.lit(1.0))


def title_words(text: Column, stop: list[str] = ()) -> Column:
    """Distinct words of a-z with more than two letters that are no stop words."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(list(stop)) if stop else F.length(x) > 2))


def ngrams(tokens: Column, n: int) -> Column:
    """Joined runs of ``n`` tokens."""
    k = F.size(tokens) - (n - 1)
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def normalize_key(key: Column) -> Column:
    return F.regexp_replace(key, r"\s*-\s*", "-")


def field_name(group: Column) -> Column:
    return F.translate(F.lower(group), "- ", "__")


def split_provider(model: Column) -> tuple[Column, Column]:
    """(model, provider) cut at the last colon; provider null without one."""
    has = model.contains(":")
    return F.when(has, F.regexp_extract(model, "^(.*):([^:]*)$", 1)).otherwise(model), F.when(has, F.regexp_extract(model, "^(.*):([^:]*)$", 2))


def content_version(text: Column) -> Column:
    """Twelve hexadecimal digits of the SHA-256."""
    return F.substr(F.sha2(text.cast("binary"), 256), F.lit(1), F.lit(12))


def fnv1a36(text: Column) -> Column:
    """FNV-1a, 32 bits, over the text's UTF-16 code units, in base 36."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: F.pmod(a.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def debate_name(url: Column) -> Column:
    """Readable name from the second-last path segment: time suffix off, hyphens as spaces, capitalised."""
    seg = F.element_at(F.split(F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)", 1), "/"), -2)
    name = F.replace(F.regexp_replace(seg, r"-\d{1,2}-\d{2}$", ""), F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2)))


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from one hour."""
    s = F.floor(F.greatest(seconds, F.lit(0)))
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def term_title(terms: Column, fallback: str = "Overig") -> Column:
    """Title from ranked terms: the first of one word, in title case."""
    first = F.try_element_at(F.filter(terms, lambda t: ~t.contains(" ")), F.lit(1))
    return F.coalesce(F.initcap(first), F.initcap(F.try_element_at(terms, F.lit(1))), F.lit(fallback))


def claim_display(text: Column) -> Column:
    """Ellipses where a claim begins without a capital or ends without punctuation."""
    a = F.when(text.rlike(r"^[\p{Lu}\d\"“']"), "").otherwise("… ")
    return F.concat(a, text, F.when(text.rlike(r"[.!?]$"), "").otherwise(" …"))


def name_order(surname: Column) -> Column:
    """``Berg van den`` as ``van den Berg``: a trailing particle goes to the front."""
    p = r"^(.*?) (van der|van den|van de|van 't|van|de|den|der|ten|ter|te|el)$"
    return F.when(surname.rlike(p), F.regexp_replace(surname, p, "$2 $1")).otherwise(surname)


def section(text: Column, marker: str, ends: list[str]) -> Column:
    """What stands after ``marker`` up to the next of ``ends`` or the end; null without the marker."""
    at = F.locate(marker, text)
    rest = F.substr(text, at + len(marker))
    stops = [F.when(F.locate(e, rest) > 0, F.locate(e, rest)) for e in ends]
    end = F.least(*stops) if len(stops) > 1 else stops[0] if stops else F.lit(None)
    return F.when(at > 0, F.trim(F.when(end.isNotNull(), F.left(rest, end - 1)).otherwise(rest)))


def _slug(s: str | None) -> str | None:
    if s is None:
        return None
    low = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    out = "".join(c if c.isascii() and c.isalnum() else "-" for c in low)
    return "-".join(x for x in out.split("-") if x)


@F.pandas_udf(StringType())
def slugify(s: pd.Series) -> pd.Series:
    """Letters without accents and digits, joined by hyphens; Spark has no Unicode decomposition."""
    return s.map(_slug)
