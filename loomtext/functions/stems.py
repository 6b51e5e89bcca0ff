"""Stems by suffix rules, as column expressions over arrays of lower-case words: Porter's rules for English, the Snowball rules' inflections and
derivations for German, and light rules (plural, gender, common endings) for French and Spanish. No word list; words of up to two letters stay.

A rule is (suffix, replacement, condition on what is before the suffix). Of a step's rules the one with the longest suffix that a word has is taken,
whether its condition holds or not. Conditions are regular expressions of vowels and consonants; an English y behind a consonant is marked as Y, a
vowel, until the end. Each step is a transform over the array, so that expressions stay as long as the rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

V, C = "[aeiouY]", "[^aeiouY]"
#: Measures of what is before a suffix: at least one, more than one, exactly one run of vowels that consonants follow.
M0, M1, ONE = f"^{C}*{V}+{C}+", f"^{C}*{V}+{C}+{V}+{C}+", f"^{C}*{V}+{C}+{V}*$"
#: A consonant, a vowel, and a consonant but w, x and y.
SHORT = f"{C}{V}[^aeiouYwxy]$"
ANY = ""

# The published rules' suffixes, replacements and conditions.
PLURALS = [("sses", "ss", ANY), ("ies", "i", ANY), ("ss", "ss", ANY), ("s", "", ANY)]
DERIVED = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
SHORTER = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
DROPPED = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _step(words: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Of the longest suffix that a word has, the replacement, if what is before it meets the condition."""

    def one(w: Column) -> Column:
        out = w
        for suffix, instead, condition in sorted(rules, key=lambda r: len(r[0])):  # the longest one is asked first
            rest = F.substring(w, F.lit(1), F.length(w) - len(suffix))
            good = rest.rlike(condition) if condition else F.lit(True)
            out = F.when(F.endswith(w, F.lit(suffix)), F.when(good, F.concat(rest, F.lit(instead))).otherwise(w)).otherwise(out)
        return out

    return F.transform(words, one)


def english(words: Column) -> Column:
    marked = F.transform(words, lambda w: F.regexp_replace(w, "(?<=[^aeiou])y", "Y"))
    out = _step(marked, PLURALS)

    def past(w: Column) -> Column:
        """Whether -ed or -ing went is seen by a sign in front, for what follows only then."""
        cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
        eed = F.when(cut(3).rlike(M0), F.concat(cut(3), F.lit("ee"))).otherwise(w)
        gone = lambda n: F.when(cut(n).rlike(V), F.concat(F.lit("+"), cut(n))).otherwise(w)
        return F.when(F.endswith(w, F.lit("eed")), eed).when(F.endswith(w, F.lit("ed")), gone(2)).when(F.endswith(w, F.lit("ing")), gone(3)).otherwise(w)

    def mended(w: Column) -> Column:
        body = F.substring(w, F.lit(2), F.length(w))
        whole = F.when(body.rlike("(?:at|bl|iz)$"), F.concat(body, F.lit("e")))
        whole = whole.when(body.rlike("([^aeiouYlsz])\\1$"), F.substring(body, F.lit(1), F.length(body) - 1))
        whole = whole.when(body.rlike(ONE) & body.rlike(SHORT), F.concat(body, F.lit("e"))).otherwise(body)
        return F.when(F.startswith(w, F.lit("+")), whole).otherwise(w)

    out = F.transform(F.transform(out, past), mended)
    out = F.transform(out, lambda w: F.when(w.rlike(f"{V}.*[yY]$"), F.regexp_replace(w, "[yY]$", "i")).otherwise(w))
    out = _step(out, [(a, b, M0) for a, b in DERIVED])
    out = _step(out, [(a, b, M0) for a, b in SHORTER])
    out = _step(out, [*[(a, "", M1) for a in DROPPED], ("ion", "", f"(?=.*[st]$){M1}")])
    e = lambda w: F.substring(w, F.lit(1), F.length(w) - 1)
    out = F.transform(out, lambda w: F.when(F.endswith(w, F.lit("e")) & (e(w).rlike(M1) | e(w).rlike(ONE) & ~e(w).rlike(SHORT)), e(w)).otherwise(w))
    return F.transform(out, lambda w: F.lower(F.when(F.endswith(w, F.lit("ll")) & e(w).rlike(M1), e(w)).otherwise(w)))


_G, _NOT_G = "[aeiouyäöü]", "[^aeiouyäöü]"
#: Before the suffix stand three letters and, from there or later, a vowel and a consonant; for derivations once more.
G1 = f"^(?=.{{3}}).*?{_G}{_NOT_G}"
G2 = f"^(?=.{{3}}).*?{_G}{_NOT_G}.*?{_G}{_NOT_G}"


def german(words: Column) -> Column:
    own = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "ß", "ss"), f"(?<={_G})u(?={_G})", "U"), f"(?<={_G})y(?={_G})", "Y"))
    out = _step(own, [("em", "", G1), ("ern", "", G1), ("er", "", G1), ("e", "", G1), ("en", "", G1), ("es", "", G1), ("s", "", f"(?=.*[bdfghklmnrt]$){G1}")])
    out = F.transform(out, lambda w: F.when(w.rlike("niss$") & ~w.rlike("^niss$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    out = _step(out, [("en", "", G1), ("er", "", G1), ("est", "", G1), ("st", "", f"(?=.{{3}}.*[bdfghklmnt]$){G1}")])
    out = _step(out, [("end", "", G2), ("ung", "", G2), ("ig", "", f"(?!.*e$){G2}"), ("ik", "", f"(?!.*e$){G2}"), ("isch", "", f"(?!.*e$){G2}"), ("lich", "", G2), ("heit", "", G2), ("keit", "", G2)])
    return F.transform(out, lambda w: F.translate(F.lower(w), "äöü", "aou"))


def french(words: Column) -> Column:
    """Plurals, feminine forms and frequent endings; accents go at the end."""
    long = "^.{3,}"
    out = _step(words, [("aux", "al", "^.{2,}"), ("eux", "eux", ANY), ("x", "", long), ("s", "", "^.{2,}[^s]$")])
    out = _step(out, [("issement", "i", long), ("ement", "", long), ("ment", "", long), ("atrice", "ateur", long), ("ation", "", long), ("euse", "eur", "^.{2,}"), ("ive", "if", "^.{2,}"), ("elle", "el", "^.{2,}"), ("enne", "en", "^.{2,}"), ("ère", "er", "^.{2,}")])
    out = _step(out, [("er", "", long), ("ée", "", long), ("é", "", long), ("ie", "i", long), ("e", "", long)])
    return F.transform(out, lambda w: F.regexp_replace(F.translate(w, "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc"), "([b-df-hj-np-tv-z])\\1$", "$1"))


def spanish(words: Column) -> Column:
    """Plurals, gender and frequent endings; accents go first."""
    out = F.transform(words, lambda w: F.translate(w, "áéíóúü", "aeiouu"))
    long = "^.{3,}"
    out = _step(out, [("ces", "z", "^.{2,}"), ("iones", "ion", "^.{2,}"), ("es", "", "^.{2,}[^aeiou]$"), ("s", "", "^.{2,}[aeo]$")])
    out = _step(out, [("amente", "", long), ("mente", "", long), ("acion", "", long), ("idad", "", long), ("ando", "", long), ("iendo", "", long), ("ado", "", long), ("ada", "", long), ("ido", "", long), ("ida", "", long), ("ar", "", long), ("er", "", long), ("ir", "", long)])
    return _step(out, [("o", "", "^.{2,}"), ("a", "", "^.{2,}"), ("e", "", "^.{2,}")])


LANGUAGES = {"en": english, "de": german, "fr": french, "es": spanish}


def stems(words: Column, lang: Column) -> Column:
    """The stems of lower-case words of a text, by its language (a column or a literal); of other languages the words as they are. A null stays one."""
    out = words
    for name, rules in LANGUAGES.items():
        long = F.transform(F.arrays_zip(words.alias("w"), rules(words).alias("s")), lambda p: F.when(F.length(p["w"]) > 2, p["s"]).otherwise(p["w"]))
        out = F.when(lang == name, long).otherwise(out)
    return out
