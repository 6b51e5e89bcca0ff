"""Text scalars as column expressions: cleaning, token estimates, keywords, query rewriting, guardrails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \s is ASCII white space.
SPACES = "\\s+"
WORDS = "[가-힣a-zA-Z0-9]+"

# Particles and stop words that results depend on.
PARTICLES = ["이란", "이란?", "란", "란?", "은", "는", "이", "가", "을", "를", "의", "에", "에서", "으로", "로", "와", "과", "도", "만", "까지", "부터", "이다", "입니다", "인가", "인가?", "인지", "하는", "되는"]
SPLIT_STOPS = ["은", "는", "이", "가", "을", "를", "에", "의", "와", "과", "에서", "로", "으로", "에게", "한테"]
ENGLISH_STOPS = ["the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "was", "for", "on", "with", "that", "this", "it", "at", "by"]
EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
PHONE_KR = "01[0-9]-?[0-9]{4}-?[0-9]{4}"
RRN_KR = "[0-9]{6}-?[1-4][0-9]{6}"
YEAR = "\\b(?:19|20)[0-9]{2}\\b"
INJECTION = ["ignore previous instructions", "disregard all prior", "forget everything", "new instructions:", "system prompt:"]
BLOCKED = ["password", "api key", "secret"]


def clean_spaces(t: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(t, SPACES, " "))


def collapse_runs(t: Column) -> Column:
    """Runs of spaces and tabs become one space, three or more line feeds two; none at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "\\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def one_line(t: Column) -> Column:
    return F.translate(t, "\n", " ")


def words(t: Column) -> Column:
    """What stands between white space; nothing for an empty text."""
    return F.filter(F.split(t, SPACES), lambda w: w != "")


def token_estimate(t: Column, chars: int = 4) -> Column:
    return F.floor(F.length(t) / F.lit(chars)).cast("long")


def word_token_estimate(t: Column) -> Column:
    """1.3 tokens a word, in whole tokens."""
    return F.floor(F.size(words(t)) * F.lit(13) / F.lit(10)).cast("long")


def token_ratio(t: Column) -> Column:
    """Tokens for each character; 0 for an empty text."""
    return F.when(F.length(t) > 0, token_estimate(t) / F.length(t)).otherwise(F.lit(0.0))


def truncate_tokens(t: Column, tokens: int, chars: int = 4) -> Column:
    return F.substring(t, 1, tokens * chars)


def regex_keywords(t: Column, stops: list[str] = ENGLISH_STOPS) -> Column:
    """Words of letters and digits longer than one that are no stop words, in order."""
    found = F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(stops))


def split_keywords(t: Column, stops: list[str] = SPLIT_STOPS) -> Column:
    return F.filter(words(t), lambda w: (F.length(w) > 1) & ~w.isin(stops))


def plain_terms(t: Column, stops: list[str] = ENGLISH_STOPS) -> Column:
    """Lower-case words of letters only without stop words."""
    return F.filter(F.split(F.lower(t), "[^a-z]+"), lambda w: (w != "") & ~w.isin(stops))


def korean_terms(t: Column, lower: bool = True) -> Column:
    """Words without punctuation and without the longest particle at their end; a word that is a particle stays."""
    body = F.regexp_replace(F.lower(t) if lower else t, "[^\\w\\s가-힣]", " ")
    ends = "|".join(p for p in sorted(PARTICLES, key=len, reverse=True) if "?" not in p)
    return F.transform(words(body), lambda w: F.regexp_replace(w, f"^(.+?)(?:{ends})$", "$1"))


def query_terms(q: Column) -> Column:
    """The query without spaces at its ends and without a question mark at its end."""
    return F.regexp_replace(F.trim(q), "\\?$", "")


def expanded(q: Column) -> Column:
    """The query, and its keywords as another one if there are any."""
    k = split_keywords(q)
    return F.array_distinct(F.when(F.size(k) > 0, F.array(q, F.concat_ws(" ", k))).otherwise(F.array(q)))


def with_synonyms(q: Column, synonyms: dict[str, list[str]]) -> Column:
    """The query, and for each term that it has, the query with each of the term's synonyms instead. Without repeats."""
    out = [F.array(q)]
    for term, others in synonyms.items():
        swapped = F.array(*[F.replace(q, F.lit(term), F.lit(o)) for o in others])
        out.append(F.when(F.contains(F.lower(q), F.lit(term.lower())), swapped).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*out))


def rewritten(q: Column, how: str) -> Column:
    """expand: the query with its keywords after it; simplify: its first three keywords of more than two characters."""
    k = regex_keywords(q)
    if how == "expand":
        return F.concat_ws(" ", q, F.concat_ws(" ", k))
    if how == "simplify":
        return F.concat_ws(" ", F.slice(F.filter(k, lambda w: F.length(w) > 2), 1, 3))
    raise ValueError(f"unknown rewriting: {how}")


def sub_queries(t: Column) -> Column:
    """Lines that begin with a number or a dash, without it."""
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^([0-9]|-)"))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[0-9.\\-)\\s]+", "")))


def pii(t: Column) -> Column:
    """Counts of e-mail addresses, phone numbers and resident numbers, and whether there is any."""
    # the pattern of addresses tries every character of every word; few texts have the sign that all addresses have
    emails = F.when(t.isNull() | F.contains(t, F.lit("@")), F.regexp_count(t, F.lit(EMAIL))).otherwise(F.lit(0))
    n = [emails, *(F.regexp_count(t, F.lit(p)) for p in (PHONE_KR, RRN_KR))]
    return F.struct(n[0].alias("emails"), n[1].alias("phones"), n[2].alias("resident_numbers"), ((n[0] + n[1] + n[2]) > 0).alias("has_pii"))


def masked(t: Column) -> Column:
    """E-mail addresses, phone and resident numbers replaced by their kind."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, EMAIL, "[EMAIL]"), RRN_KR, "[REDACTED]"), PHONE_KR, "[PHONE]")


def phrases_in(t: Column, phrases: list[str]) -> Column:
    """The phrases that a text has, whatever the case, in the list's order."""
    low = F.lower(t)
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, F.lower(p)))


def valid_input(t: Column) -> Column:
    return ~pii(t)["has_pii"] & (F.size(phrases_in(t, INJECTION)) == 0) & (F.size(phrases_in(t, BLOCKED)) == 0)


def years(t: Column, century_only: bool = False) -> Column:
    """Distinct years; century_only gives their first two digits, as a pattern with one group would."""
    y = F.regexp_extract_all(t, F.lit(YEAR), F.lit(0))
    return F.array_distinct(F.transform(y, lambda x: F.substring(x, 1, 2)) if century_only else y)


def hallucination_risk(answer: Column, context: Column, wrong_terms: list[str], century_only: bool = False) -> Column:
    """high from two findings on, medium with one: a finding is a wrong term, or years that the context hasn't."""
    terms = F.size(phrases_in(answer, wrong_terms))
    missing = F.size(F.array_except(years(answer, century_only), years(context, century_only)))
    n = terms + F.when(missing > 0, 1).otherwise(0)
    return F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low")


def citations(t: Column) -> Column:
    """Numbers in brackets, each once, in ascending order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("\\[([0-9]+)\\]"), F.lit(1)), lambda x: x.cast("long"))))


def document_key(name: Column, text: Column) -> Column:
    """The first 12 digits of the md5 of name and length."""
    return F.substring(F.md5(F.concat_ws("_", name, F.length(text).cast("string"))), 1, 12)


def preview(t: Column, n: int = 200) -> Column:
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def keyword_in_context(t: Column, word: Column, before: int = 50, after: int = 100) -> Column:
    """The first place of a word with what stands around it; null where the word isn't."""
    at = F.position(F.lower(word), F.lower(t))
    lo = F.greatest(at - before, F.lit(1))
    hi = F.least(at + F.length(word) + after, F.length(t) + 1)
    body = t.substr(lo, hi - lo)
    out = F.concat(F.when(lo > 1, "...").otherwise(""), body, F.when(hi <= F.length(t), "...").otherwise(""))
    return F.when(at > 0, out)
