"""Text expressions built from Spark SQL functions only, so they stay inside code generation."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Letters whose decompositions the fold and token rules have to know. The blocks are Latin-1 to
# Latin Extended-B, Greek and Cyrillic, Latin Extended Additional, Greek Extended and the
# half/full-width forms; the tables below are derived from Unicode data for these ranges.
LETTER_BLOCKS = ((0xAA, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0xFF00, 0xFF5F))


@lru_cache(maxsize=None)
def decomposition_tables(form: str) -> tuple[dict[str, str], dict[str, str]]:
    """(one-letter bases, longer replacements) of every marked letter for a normal form."""
    single, longer = {}, {}
    for start, stop in LETTER_BLOCKS:
        for point in range(start, stop):
            letter = chr(point)
            plain = unicodedata.normalize(form, letter)
            if plain == letter:
                continue
            base = "".join(c for c in plain if not unicodedata.combining(c))
            if len(base) == 1:
                single[letter] = base
            else:
                longer[letter] = base
    return single, longer


def let(column: Column, body) -> Column:
    """``body`` of a value computed once per row, for expressions that use it several times."""
    return F.get(F.transform(F.array(column), lambda value: body(value)), F.lit(0))


def _ranges(letters) -> str:
    """The letters as regular expression ranges."""
    points, spans = sorted(ord(c) for c in letters), []
    for point in points:
        if spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


def _translate(column: Column, table: dict[str, str]) -> Column:
    return F.translate(column, "".join(table), "".join(table.values()))


def one_space(column: Column) -> Column:
    """Trim and collapse runs of whitespace."""
    return F.trim(F.regexp_replace(column, r"(?U)\s+", " "))


def fold_text(column: Column) -> Column:
    """Case- and accent-insensitive form used for keyword matching.

    Dotless and dotted i become plain letters before lower-casing; marks vanish without
    splitting the word.
    """
    single, _ = decomposition_tables("NFD")
    plain = _translate(F.translate(column, "ıİ", "iI"), single)
    return F.lower(F.regexp_replace(plain, r"[̀-ͯ]", ""))


def tokens(column: Column) -> Column:
    """Word tokens for fingerprints: lower case, compatibility forms, length above two.

    A mark is not a letter, so it separates words: every marked letter is followed by a space
    before its base letter is put in.
    """
    single, longer = decomposition_tables("NFKD")
    spaced = {c: b for c, b in single.items() if unicodedata.normalize("NFKD", c) != b}
    lowered = F.lower(column)
    # The look-ahead keeps plain letters away from the long list of ranges.
    split = F.regexp_replace(lowered, rf"(?=[^\x00-\xa9])([{_ranges(spaced)}])", "$1 ")
    plain = _translate(split, single)
    ligatures = [c for c in longer if c.isalnum() and c == c.lower()]
    expanded = plain
    for letter in ligatures:
        expanded = F.replace(expanded, F.lit(letter), F.lit(longer[letter]))
    plain = F.when(plain.rlike(f"[{''.join(ligatures)}]"), expanded).otherwise(plain)
    # Plain texts need none of this.
    marked = F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), " ")
    cut = F.when(lowered.rlike(r"[^\x00-\x7F]"), marked).otherwise(F.split(lowered, r"[^a-z0-9]+"))
    return F.filter(cut, lambda t: F.char_length(t) > 2)


def sanitize_text(column: Column) -> Column:
    """Drop NUL characters and byte sequences that are not valid text."""
    return F.regexp_replace(F.make_valid_utf8(column), "\\x00", "")


def content_hash(column: Column) -> Column:
    return F.sha2(column, 256)


def dash_clean(column: Column) -> Column:
    """Replace em and en dashes, and the blanks around them, by a comma."""
    return F.trim(F.array_join(F.transform(F.split(column, "[—–]"), lambda part: stripped(part)), ", "))


def stripped(column: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def clean_title(column: Column) -> Column:
    """Drop a site name after the last ' | ' or ' – ': at most fifty characters behind a headline of
    at least twenty."""

    def cleaned(title: Column) -> Column:
        site = F.element_at(F.split(title, "[|–]"), -1)
        head = F.substring(title, F.lit(1), F.char_length(title) - F.char_length(site) - 1)
        apart = (F.char_length(site) < F.char_length(title)) & (F.ltrim(site) != site) & (F.rtrim(head) != head)
        fits = F.char_length(F.trim(site)).between(1, 50) & (F.char_length(F.rtrim(head)) >= 20)
        return F.when(apart & fits, F.trim(head)).otherwise(title)

    return let(F.trim(column), cleaned)


def _numeric_entities(column: Column, digits: str, base: int) -> Column:
    """Replace every numeric entity by its character; ``digits`` has one group, the number."""

    def letter(code: Column) -> Column:
        as_hex = code if base == 16 else F.hex(code.cast("bigint"))
        return F.coalesce(F.decode(F.unhex(F.lpad(as_hex, 8, "0")), "UTF-32"), F.lit(""))

    def decoded(text: Column) -> Column:
        codes = F.regexp_extract_all(text, F.lit(digits), F.lit(1))
        pairs = F.zip_with(F.split(text, digits, -1), F.transform(codes, lambda c: letter(c)), lambda p, d: F.concat(p, F.coalesce(d, F.lit(""))))
        return F.when(F.contains(text, F.lit("&#")), F.array_join(pairs, "")).otherwise(text)

    return let(column, decoded)


def decode_entities(column: Column) -> Column:
    """Unwrap CDATA, decode numeric and the common named entities, trim. Ampersand comes last."""
    text = F.regexp_replace(column, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    text = _numeric_entities(text, "(?i)&#x([0-9a-f]{1,6});", 16)
    text = _numeric_entities(text, "&#([0-9]{1,7});", 10)
    for entity, plain in NAMED_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# The named entities and their order of decoding.
NAMED_ENTITIES = (
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
)


def embedding_input(title: Column, text: Column, words: int | None = None, limit: int | None = None) -> Column:
    """Title and text as one embedding request; ``words`` and ``limit`` are for models that read only
    so many words or characters."""
    split = F.split(F.trim(text), r"(?U)\s+")
    body = F.when(F.coalesce(text, F.lit("")) == "", title).otherwise(F.concat(title, F.lit("\n\n"), F.array_join(split if words is None else F.slice(split, 1, words), " ")))
    return body if limit is None else F.substring(body, 1, limit)


def parse_date(column: Column) -> Column:
    """Timestamp from ISO, RFC 822 or compact UTC text; null when it is not a date."""
    named = r"^\d{1,2} [A-Za-z]{3} \d{4} "

    def parsed(text: Column) -> Column:
        day_first = F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},\s*", "")
        return (
            F.when(text.rlike(r"^\s*\d{4}-\d{2}"), F.try_to_timestamp(text))
            .when(text.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssX")))
            .when(day_first.rlike(named + r"\S+ [A-Z]"), F.try_to_timestamp(day_first, F.lit("d MMM yyyy HH:mm:ss z")))
            .when(day_first.rlike(named + r"\S+ [+-]"), F.try_to_timestamp(day_first, F.lit("d MMM yyyy HH:mm:ss xx")))
        )

    return let(column, parsed)


def expand_keyword(column: Column) -> Column:
    """Array of the separate terms in a list entry such as 'Name (ABBR) / Other name'."""

    def parts(entry: Column) -> Column:
        """The entry, or what stands before and inside brackets at its end."""
        inside = F.substring_index(F.rtrim(entry), "(", -1)
        before = F.substring(entry, F.lit(1), F.char_length(F.rtrim(entry)) - F.char_length(inside) - 1)
        bracketed = F.endswith(inside, F.lit(")")) & (F.locate(")", inside) == F.char_length(inside)) & (F.char_length(inside) > 1) & F.contains(entry, F.lit("("))
        return F.when(bracketed, F.array(before, F.translate(inside, ")", ""))).otherwise(F.array(entry))

    entries = F.flatten(F.transform(F.split(column, r"\s/\s"), parts))
    return F.filter(F.transform(entries, lambda t: F.trim(t)), lambda t: t != "")


def is_acronym(term: Column) -> Column:
    """Short all-capital terms match whole words in the original spelling."""
    return (F.char_length(term) <= 4) & (term == F.upper(term)) & term.rlike("[A-Z]")


def contains_term(text: Column, term: Column) -> Column:
    """Lower-case text holds the term, or the term with a decimal comma."""
    lowered = F.lower(term)
    comma = F.regexp_replace(lowered, r"^([^.]*)\.", "$1,")
    return F.contains(text, lowered) | (lowered.rlike(r"\d\.\d") & F.contains(text, comma))


def keywords_from_reason(reason: Column) -> Column:
    """Keyword list inside a match reason; empty array when there is none."""
    after = F.try_element_at(F.split(reason, "keywords", 2), F.lit(2))
    listed = F.coalesce(F.trim(F.try_element_at(F.split(after, ":", 2), F.lit(2))), F.lit(""))
    words = F.transform(F.split(listed, ","), lambda w: F.trim(w))
    return (
        F.when(listed != "", words)
        .when(reason == "keyword", F.array(F.lit("(keyword match, earlier rule)")))
        .otherwise(F.array().cast("array<string>"))
    )


def read_minutes(words: Column) -> Column:
    """Reading time at 200 words a minute, never under three."""
    return F.greatest(F.lit(3), F.floor(words / 200 + F.lit(0.5))).cast("bigint")


def word_count(column: Column) -> Column:
    return F.size(F.split(column, r"(?U)\s+")).cast("bigint")


# Profiles of frequent short words per language.
LANGUAGE_WORDS = {
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "den", "von", "ein", "eine", "auf", "für", "sich", "dem", "auch", "wie", "bei", "werden", "oder"),
    "en": ("the", "and", "of", "to", "in", "that", "is", "was", "for", "with", "as", "on", "are", "this", "by", "from", "have", "not", "they", "which"),
    "es": ("el", "los", "las", "y", "que", "en", "una", "por", "con", "para", "del", "como", "más", "pero", "su", "al", "lo", "es", "se", "sin"),
    "fr": ("le", "la", "les", "et", "des", "est", "une", "dans", "qui", "pour", "pas", "sur", "avec", "du", "au", "elle", "ce", "par", "entre", "sont"),
    "tr": ("ve", "bir", "bu", "da", "de", "için", "ile", "çok", "daha", "olan", "gibi", "kadar", "sonra", "ancak", "olarak", "ama", "değil", "var", "her", "ne"),
}


# Writing systems that stand for one language here.
SCRIPT_LANGUAGES = {"ar": "Arabic", "el": "Greek", "he": "Hebrew", "hi": "Devanagari", "ja": "Hiragana}\\p{IsKatakana", "ko": "Hangul", "ru": "Cyrillic", "th": "Thai", "zh": "Han"}


def detect_language(column: Column, fallback: str | None = None) -> Column:
    """Language of a text: by its writing system where at least half of its letters are of one that
    stands for a language, else the one with the most profile words; ``fallback`` (null if not asked
    for) where nothing tells. Ties go to the language first in alphabetical order.
    """

    def letters(text: Column, pattern: str) -> Column:
        return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))

    def by_script(text: Column) -> Column:
        return F.coalesce(*[F.when(letters(text, f"[\\p{{Is{script}}}]") * 2 >= letters(text, r"\p{L}"), F.lit(lang)) for lang, script in SCRIPT_LANGUAGES.items()])

    def by_words(text: Column) -> Column:
        words = F.split(F.lower(text), r"[^\p{L}]+")
        score = lambda profile: F.size(F.filter(words, lambda w: w.isin(*profile)))
        scores = [F.struct(score(p).alias("score"), F.lit(-n).alias("rank"), F.lit(lang).alias("lang")) for n, (lang, p) in enumerate(sorted(LANGUAGE_WORDS.items()))]
        return let(F.array_max(F.array(*scores)), lambda best: F.when(best["score"] > 0, best["lang"]))

    # Latin texts skip the look at other writing systems.
    other = column.rlike(r"[\p{L}&&[^\p{IsLatin}]]")
    return F.coalesce(F.when(other, by_script(column)), by_words(column), F.lit(fallback).cast("string"))
