"""Terms of a task, and how they match names, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, STEM = 3, 4

#: Words that say nothing about the part of a code base that is meant.
STOP_WORDS = tuple(
    """
    a about actually after all also an and any anything are at basically be been before bit bro but by can correctly
    could currently did do does doesnt dont dude each ever everything for from gonna good great guys had has have
    hello hey how i if in instead into is it its just kinda lets like literally man maybe need needs nice no nope not
    now of okay on one only or our out own per perhaps please pls plz pretty properly quite really should simply so
    some something still stuff sure than thank thanks that the their them then these they thing things this those
    three to two very via wanna want was way ways we were what when where whether which while who why will with would
    yeah yep you your
    """.split()
)


def task_terms(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case terms in order: pieces of words (cut before capitals), then the words themselves."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_\s/-]", " "), r"[\s/_-]+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.array_append(F.split(w, "(?=[A-Z])"), w))
    terms = F.transform(F.flatten(each), F.lower)
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= LEAST) & ~t.isin(*stop_words) if stop_words else F.length(t) >= LEAST))


def matches(term: Column, candidate: Column) -> Column:
    """Whether a name contains a term, its plural or its stem."""
    name = F.lower(candidate)

    def without(ending: str) -> Column:
        stem = F.substring(term, F.lit(1), F.length(term) - len(ending))
        return F.endswith(term, F.lit(ending)) & (F.length(stem) >= STEM) & F.contains(name, stem)

    return F.contains(name, term) | F.contains(name, F.concat(term, F.lit("s"))) | without("s") | without("ing") | without("ed")


def own_name(name: Column) -> Column:
    """What follows a name's last dot."""
    return F.substring_index(name, ".", -1)


# Quotes, straight and curly; file types that a prompt may name; openings of requests and questions.
_QUOTES = "\"'`\u201c\u201d\u2018\u2019"
_SOURCES = "tsx?|jsx?|prisma|json|css"
_REQUEST = r"(?i)^\s*(please\b|(can|could|would|will|why\s+don'?t|how\s+about)\s+(you|we|i)\b)"
_ASKING = r"(?i)^\s*(where|what|which|who|whom|whose|when|why|how)\b"
_THERE = r"(?i)^\s*(is|are|was|were)\s+(there|any)\b"
_IMPERATIVE = (
    r"(?i)\b(add|fix|chang|updat|refactor|renam|remov|delet|implement|creat|writ|mak|mov|extract|replac|migrat|revert|wir|support|improv|clean|split|merg|introduc|build|switch)"
    r"(e|es|ed|ing|s)?\b"
)
#: Words that stand in paths everywhere.
STRUCTURAL = tuple(
    """
    src lib app api apps packages components component utils util helpers helper shared common core index test tests
    spec specs types type config route routes page pages server client server.ts tsx jsx
    """.split()
)
SEPARATOR, MOST_PROMPTS, MOST_CHARS = " | ", 3, 400


def quoted_phrases(task: Column) -> Column:
    """Distinct lower-case phrases of two words or more, 6 to 120 characters, that a task quotes."""
    found = F.regexp_extract_all(task, F.lit(f"[{_QUOTES}]([^{_QUOTES}]{{6,120}})[{_QUOTES}]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda p: F.lower(F.trim(p))), lambda p: p.rlike(r"\s")))


def named_paths(prompt: Column) -> Column:
    """Distinct lower-case paths of source files that a prompt names."""
    found = F.regexp_extract_all(prompt, F.lit(rf"(?:^|[\s`'\"(\[])((?:[\w.@/-]*/)?[\w.-]+\.(?:{_SOURCES}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: F.lower(F.regexp_replace(F.regexp_replace(p, r"^\./", ""), "^@/", ""))))


def named_identifiers(prompt: Column) -> Column:
    """Distinct identifiers that a prompt names: in backticks, called, or in camel case."""
    patterns = (r"`([\w.$]{2,})`", r"\b([A-Za-z_$][\w$]*)\s*\(\)", r"\b([a-z$][\w$]*[A-Z][\w$]*|[A-Z][a-z$][\w$]*)\b")
    return F.array_distinct(F.concat(*[F.regexp_extract_all(prompt, F.lit(p), F.lit(1)) for p in patterns]))


def is_question(prompt: Column) -> Column:
    """Whether a prompt asks rather than tells; polite requests tell."""
    text = F.trim(prompt)
    asks = text.rlike(_ASKING) | text.rlike(_THERE) | (text.rlike(r"\?\s*$") & ~text.rlike(_IMPERATIVE))
    return F.coalesce((text != "") & ~text.rlike(_REQUEST) & asks, F.lit(False))


def widened_task(task: Column, prompt: Column) -> Column:
    """A task's text with one more prompt: the first and the newest stay, what lies between goes first."""
    said = F.filter(F.transform(F.split(task, r" \| "), F.trim), lambda p: p != "")
    fresh = F.trim(prompt)
    kept = F.filter(F.when(F.array_contains(said, fresh), said).otherwise(F.concat(said, F.array(fresh))), lambda p: p != "")
    window = F.when(F.size(kept) <= MOST_PROMPTS, kept).otherwise(F.concat(F.slice(kept, 1, 1), F.slice(kept, -(MOST_PROMPTS - 1), MOST_PROMPTS - 1)))
    ends = F.concat(F.slice(window, 1, 1), F.slice(window, -1, 1))
    window = F.when((F.size(window) > 2) & (F.length(F.array_join(window, SEPARATOR)) > MOST_CHARS), ends).otherwise(window)
    text, newest = F.array_join(window, SEPARATOR), F.element_at(window, -1)
    room = F.lit(MOST_CHARS - len(SEPARATOR)) - F.length(newest)
    opening = F.trim(F.substring(window[0], F.lit(1), F.greatest(room, F.lit(0))))
    short = F.when(F.length(newest) >= MOST_CHARS, F.trim(F.substring(newest, 1, MOST_CHARS))).when(opening != "", F.concat(opening, F.lit(SEPARATOR), newest)).otherwise(newest)
    return F.when(F.size(kept) == 0, F.lit("")).when(F.length(text) <= MOST_CHARS, text).otherwise(short)


def first_said(*fields: Column) -> Column:
    """The first field that is not blank."""
    return F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields])
