"""Word stems by suffix stripping, as column expressions.

Every language has a list of steps; a step is a pattern and what stays of its match, and the steps run in
order over the whole word. The patterns use only what all common regular expression engines know.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ENGLISH = (
    (r"^(.*s)ses$", "1s"),
    (r"^(.{2,})ies$", "1y"),
    (r"^(.*[aeiouy].*[^su])s$", "1"),
    *((rf"^(.*[aeiouy]{c}){c}(?:ed|ing)$", "1") for c in "bdgmnprt"),
    (r"^(.*[aeiouy].*[^aeiou]{2})(?:ed|ing)$", "1"),
    (r"^(.*[aeiouy].*)(?:ed|ing)$", "1"),
    (r"^(.*[aeiouy].*(?:at|bl|iz))$", "1e"),
    (r"^(.{3,})(?:ational|ation|ator)$", "1ate"),
    (r"^(.{3,})(?:fulness|ousness|iveness)$", "1"),
    (r"^(.{3,})(?:ness|ment|ly)$", "1"),
    (r"^(.{3,})e$", "1"),
    (r"^(.*[aeiouy].*)y$", "1i"),
)
_TURKISH = (
    (r"^(.{2,})(?:ların|lerin|ları|leri|lar|ler)(?:dan|den|da|de|a|e|ı|i)?$", "1"),
    (r"^(.{3,})(?:ndan|nden|nda|nde|dan|den|tan|ten|da|de|ta|te)$", "1"),
    (r"^(.{3,})(?:nın|nin|nun|nün|ın|in|un|ün)$", "1"),
    (r"^(.{3,})(?:yla|yle|la|le)$", "1"),
    (r"^(.{3,})(?:sı|si|su|sü|yı|yi|yu|yü)$", "1"),
)
_GERMAN = (
    (r"^(.{3,})(?:ern|em|er|en|es|e)$", "1"),
    (r"^(.{3,}[bdfghklmnrt])s$", "1"),
    (r"^(.{3,})(?:est|er|en)$", "1"),
    (r"^(.{4,})(?:heit|keit|isch|lich|ung|ig|ik)$", "1"),
)
_FRENCH = (
    (r"^(.{3,})(?:issements|issement|ements|ement|ments|ment)$", "1"),
    (r"^(.{3,})(?:ations|ation|ateurs|ateur|atrice)$", "1"),
    (r"^(.{3,})eaux$", "1eau"),
    (r"^(.{3,})aux$", "1al"),
    (r"^(.{3,})(?:euses|euse|eux|ives|ive|ifs|if)$", "1"),
    (r"^(.{3,})(?:ées|ée|és|é|er|ez|es|e|s)$", "1"),
)
_SPANISH = (
    (r"^(.{3,})(?:amientos|amiento|imientos|imiento|mente)$", "1"),
    (r"^(.{3,})(?:aciones|ación|adores|adora|ador)$", "1"),
    (r"^(.{3,})(?:idades|idad|ivas|iva|ivos|ivo|osas|osa|osos|oso)$", "1"),
    (r"^(.{3,})(?:ándose|iéndose|ando|iendo|adas|ada|ados|ado|idas|ida|idos|ido|ar|er|ir)$", "1"),
    (r"^(.{3,})(?:es|as|os|s|a|o|e)$", "1"),
)
STEPS = {"de": _GERMAN, "en": _ENGLISH, "es": _SPANISH, "fr": _FRENCH, "tr": _TURKISH}
OTHERWISE = "en"


def stem(word: Column, language: Column) -> Column:
    """The stem of a lower-case word in its language; English rules where the language has none."""
    known = F.when(language.isin(*STEPS), language).otherwise(F.lit(OTHERWISE))

    def run(steps) -> Column:
        out = word
        for pattern, stays in steps:
            out = F.regexp_replace(out, pattern, "$1" + stays[1:])
        return out

    cases = [(name, run(steps)) for name, steps in sorted(STEPS.items()) if name != OTHERWISE]
    out = F.when(known == OTHERWISE, run(STEPS[OTHERWISE]))
    for name, column in cases:
        out = out.when(known == name, column)
    return out


def stem_sql(word: str, language: str) -> str:
    """The same in SQL."""

    def run(steps) -> str:
        out = word
        for pattern, stays in steps:
            quoted = pattern.replace("'", "''")
            out = f"regexp_replace({out}, '{quoted}', '\\1{stays[1:]}')"
        return out

    cases = " ".join(f"WHEN {language} = '{name}' THEN {run(steps)}" for name, steps in sorted(STEPS.items()) if name != OTHERWISE)
    return f"CASE {cases} ELSE {run(STEPS[OTHERWISE])} END"
