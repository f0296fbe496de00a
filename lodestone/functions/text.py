"""Text functions on columns. All work on code points and give null for null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemming import stemmed

#: The phrases that count as declining to answer, and the mark of a question without an answer.
NO_ANSWER_PHRASES = ("i don't know", "i do not know", "not provided in the context", "not in the context", "not mentioned in the context", "the context does not provide", "cannot be answered", "no information")
NO_ANSWER_SENTINEL = "__NO_ANSWER__"
#: Sentence ends in the order in which they are tried.
SENTENCE_ENDS = (". ", "?\n", "!\n", "? ", "! ", ".\n")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def drop_controls(c: Column | str) -> Column:
    """Without NUL, other control characters except tab and newline, DEL and C1; offsets of what precedes them stay."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")


def sanitize(c: Column | str) -> Column:
    return strip(drop_controls(c))


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of spaces and tabs become a space, two or more newlines become two; stripped."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"[ \t]+", " "), r"\n{2,}", "\n\n"))


def truncate(c: Column | str, most: int, suffix: str = "...") -> Column:
    c = col(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix)))


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.length(col(c)) / 4).cast("long")


def words(c: Column | str) -> Column:
    """Parts between white space."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda x: x != "")


def terms(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


#: Analyzers by name, and the languages whose stop words and endings they take off, in order.
ANALYZERS = {"plain": (), "en": ("en",), "ru": ("ru",), "mixed": ("ru", "en")}


def analyzed(c: Column | str, analyzer: str = "plain") -> Column:
    """The terms that an analyzer makes of a text: `plain` keeps all as they are, the others drop stop words and stem.
    Terms that are left stand one after another, whatever was dropped between them."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}")
    return stemmed(terms(c), ANALYZERS[analyzer])


def eval_tokens(c: Column | str) -> Column:
    """Lower-cased ASCII letters and digits in runs, for answer metrics; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def first_sentence(c: Column | str) -> Column:
    """Up to the first end that occurs, ends tried in their fixed order; stripped."""
    c = col(c)
    out = F.when(F.lit(False), F.lit(""))
    for end in SENTENCE_ENDS:
        out = out.when(F.instr(c, end) > 0, F.substring(c, F.lit(1), F.instr(c, end) - 1))
    return strip(out.otherwise(c))


def declines(c: Column | str) -> Column:
    """Whether the text says that it has no answer; false for null."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return F.exists(F.array(*[F.lit(p) for p in NO_ANSWER_PHRASES]), lambda p: F.contains(low, p))


def clean_title(c: Column | str, most: int = 120) -> Column:
    bare = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^\"+|\"+$", ""), r"^'+|'+$", ""))
    return F.substring(strip(F.regexp_replace(bare, r"[.!?:;]$", "")), 1, most)


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), r"\.([^./\\]+)$", 1))


def masked(c: Column | str, shown: int = 4) -> Column:
    c = col(c)
    return F.when(F.length(c) <= shown, F.repeat(F.lit("*"), 8)).otherwise(F.concat(F.repeat(F.lit("*"), 8), F.right(c, F.lit(shown))))


def as_bool(c: Column | str) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False)


def as_list(c: Column | str) -> Column:
    """A JSON array of strings or comma-separated values, without blanks."""
    c = strip(c)
    parts = F.coalesce(F.when(c.startswith("["), F.from_json(c, "array<string>")), F.split(c, ","))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentence_list(c: Column | str) -> Column:
    """Parts that end with . ! or ?, stripped, without blank ones; such a mark that begins a part doesn't end it."""
    parts = F.regexp_extract_all(col(c), F.lit(r"(?s)(.[^.!?]*[.!?]|.+\z)"), F.lit(1))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def uuids(values: Column | str) -> Column:
    """The elements of an array of strings that are UUIDs, lower-cased, in order."""
    low = F.transform(col(values), lambda x: F.lower(F.trim(x)))
    return F.filter(low, lambda x: F.coalesce(x.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False)))


def iso_time(c: Column | str) -> Column:
    """A timestamp as YYYY-MM-DDTHH:MM:SS."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")


def parse_time(c: Column | str) -> Column:
    """The timestamp without zone that an ISO text says, null for any other text."""
    return F.try_to_timestamp(F.regexp_replace(col(c), "T", " ")).cast("timestamp_ntz")


#: Fixed value: how a numbered question is asked for.
QUESTION_PATTERN = r"(?i)\b(show|display|give|list)\b.*\bquestion\s+\d+\b"


def asks_for_question(c: Column | str) -> Column:
    """Whether a text asks to show, display, give or list a numbered question."""
    return F.coalesce(col(c).rlike(QUESTION_PATTERN), F.lit(False))


def missed_tokens(read: Column, hit: Column, created: Column | None = None) -> Column:
    """Input tokens that no cache held, at least 0; null where the input is unknown."""
    used = F.coalesce(hit, F.lit(0)) + (F.lit(0) if created is None else F.coalesce(created, F.lit(0)))
    return F.when(read.isNotNull(), F.greatest(read - used, F.lit(0)))


def provider(model: Column | str) -> Column:
    """Who offers a model, by the beginning of its name."""
    m = col(model)
    return F.when(m.startswith("gpt-") | m.startswith("text-embedding-"), "openai").when(m.startswith("claude-"), "anthropic").when(m.startswith("voyage-"), "voyage").otherwise("ollama")


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))
